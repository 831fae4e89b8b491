"""Ledger analytics on PySpark: lazy DataFrame -> DataFrame operators."""
