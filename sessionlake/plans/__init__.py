"""Operators put together: the query catalogue and the export, review, publish and diff plans."""
