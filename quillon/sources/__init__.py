"""Readers and writers: tolerant tables, gene-set files, matrix slices, cached lookups, guarded sinks."""
