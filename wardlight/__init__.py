"""Insider-threat analytics as PySpark DataFrame operators.

Every operator is a function from DataFrames (and column names) to a DataFrame.
"""
