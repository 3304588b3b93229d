"""Operators for preparing large training corpora, each a Spark job over whole tables."""
