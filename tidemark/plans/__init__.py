"""Composed queries: each is a function of (spark, sf_dir) with its SQL twin."""
