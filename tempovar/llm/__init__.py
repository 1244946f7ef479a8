"""Operators of a training-data pipeline: one module per operator, thin queries in ``queries``."""
