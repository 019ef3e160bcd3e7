"""Operators of a training-data pipeline: each module is one operator, ``queries`` registers one query for each."""
