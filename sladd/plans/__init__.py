"""Whole-text analysis and the registered queries."""
