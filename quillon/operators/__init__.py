"""Operators over contrasts, effects, profiles, tensors, graphs and lookups."""
