"""Operators of a training-data pipeline; nothing else in modlark imports them."""
