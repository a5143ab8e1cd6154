"""Operators of a training-text pipeline; nothing outside this folder imports them."""
