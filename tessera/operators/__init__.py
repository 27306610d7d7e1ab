"""Operators on matrices and vectors."""
