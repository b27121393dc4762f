"""Operators for text that language models are trained on. Nothing outside this package imports it."""
