"""Structured Streaming: the batch operators' stateful twins."""
