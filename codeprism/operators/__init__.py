"""Operators over symbols, calls, lines and diagnostics."""
