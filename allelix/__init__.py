"""Aligned categorical data on Spark: a samples x loci table of states, and the queries on it."""
