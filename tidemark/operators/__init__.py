"""Relational and sequence operators over book/chapter keyed tables."""
