"""Operators of a training-data pipeline: rules, dedup, scoring, tokens, archives."""
