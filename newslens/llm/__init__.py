"""Operators that prepare training text: one module per operator, queries in ``registry``."""
