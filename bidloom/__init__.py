"""Supplier matching and corpus preparation as Spark plans."""
