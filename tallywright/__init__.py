"""Ledger, document, search, evaluation and finance operators on PySpark DataFrames."""
