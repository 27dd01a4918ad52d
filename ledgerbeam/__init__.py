"""Ledger reconciliation and debt recalculation on Spark DataFrames."""
