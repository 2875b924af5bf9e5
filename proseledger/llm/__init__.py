"""Operators for preparing training text: counting, scanning, encoding, deduplicating, judging and sharding.

Nothing outside this subpackage imports it.
"""
