"""Retail lakehouse analytics on Spark: DataFrame-in, DataFrame-out functions.

Layout
------
functions  Column helpers (money, rounding, masks, segments, risk levels)
sources    readers, writers and the mapping from the given tables to retail tables
operators  ingest, drift governance, cleaning, dimensions, facts, access, features, models
plans      KPI reports, the star-schema build and the registry of checked queries
streaming  Structured Streaming order metrics, alerts and messages
"""
