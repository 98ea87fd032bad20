"""Session Lake: conversation logs of coding agents as Spark DataFrames.

Readers (:mod:`sessionlake.sources`) turn nine log formats into one session schema; operators
(:mod:`sessionlake.operators`) anonymize, redact, scan, merge, compare and sum up sessions; plans
(:mod:`sessionlake.plans`) put them together as export, review, publish and diff.
"""
