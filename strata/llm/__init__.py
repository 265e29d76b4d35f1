"""Operators for preparing large training collections."""
