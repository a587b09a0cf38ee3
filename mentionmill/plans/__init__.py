"""Chains of operators that make the finished count tables."""
