"""Operators on alignments: DataFrame in, DataFrame out."""
