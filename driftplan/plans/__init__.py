"""Reconciliation plans."""
