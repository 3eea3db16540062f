"""Reconciliation of tabular datasets on Spark."""
