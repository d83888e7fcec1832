"""Operators of a training-data pipeline; see ``queries`` for what is registered."""
