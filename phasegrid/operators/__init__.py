"""Relational operators on interferogram stacks."""
