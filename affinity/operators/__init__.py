"""Relational operators of the similarity engine and of the sampler."""
