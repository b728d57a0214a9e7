"""Lazy DataFrame operators, one module per area of the original system."""
