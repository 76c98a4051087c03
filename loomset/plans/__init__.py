"""Whole queries put together from operators, and the request layer."""
