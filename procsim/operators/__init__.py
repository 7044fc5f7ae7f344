"""Operators on model, item, net and trace tables."""
