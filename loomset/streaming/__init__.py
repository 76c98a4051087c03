"""Streams: an extension beside the batch operators."""
