"""Operators over inventories: differences, matches, actions."""
