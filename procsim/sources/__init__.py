"""Readers of model files and of stand-in corpora."""
