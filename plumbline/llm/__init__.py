"""Operators for training text.  Nothing outside of this subpackage imports it."""
