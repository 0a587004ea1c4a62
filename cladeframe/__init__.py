"""Parsimony analysis of discrete character matrices as Spark DataFrame jobs."""
