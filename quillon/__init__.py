"""Contrast analytics on Spark: gated shrinkage ranking, effect edges, profiles, nulls, tensors and lookups."""
