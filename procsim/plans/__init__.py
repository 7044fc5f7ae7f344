"""Public entry points and the registered queries with their SQL."""
