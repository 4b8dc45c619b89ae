"""Operators for preparing training text: sharding, licence scans, tokenising, scoring, joins, mixing, deduplication, rules."""
