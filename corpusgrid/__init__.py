"""Corpus and block-layout analytics as Spark plans."""
