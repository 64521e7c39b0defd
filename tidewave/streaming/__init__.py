"""Structured Streaming counterparts of operators that only look back."""
