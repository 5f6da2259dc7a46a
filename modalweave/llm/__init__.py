"""Operators of a training-data pipeline: one module each, their registered queries in ``queries``."""
