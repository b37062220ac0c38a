"""Whole workflows made of operators."""
