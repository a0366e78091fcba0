"""Structured Streaming over the event table: an extension, as the batch operators have no stream of their own."""
