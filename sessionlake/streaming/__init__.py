"""Structured Streaming forms: windows, pairing, upserts. Each works on a stream and on a table alike."""
