"""Readers: each gives sessions in the one schema of :mod:`sessionlake.schema`."""
