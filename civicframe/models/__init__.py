"""Regression on Spark aggregates, predictions, tables, natural breaks.

Rows stay in Spark.  A fit reads a few sums per slice, solves a k by k system on
the driver and sends the coefficients back as literals.
"""
