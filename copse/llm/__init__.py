"""Training-data operators: licence scan, packing, quality, sharding, HTML, language, PII, joins, dedup.

Nothing outside this subpackage imports it.
"""
