"""Comparison of business-process models over whole corpora, as Spark DataFrames.

The public surface is in ``procsim.plans.api``; see README.md.
"""
