"""Palisand: portfolio and time-series analytics expressed as Spark plans."""
