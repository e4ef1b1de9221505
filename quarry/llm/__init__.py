"""Operators for preparing training text: one module per operator, numpy on flat UTF-8 inside Spark tasks."""
