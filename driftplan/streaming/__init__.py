"""Streaming: an extension, keeping reconciliation current from a log of inventory changes."""
