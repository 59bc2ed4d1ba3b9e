"""Operators for preparing training text: mixing, near-duplicates, decontamination, scans, sharding and token files.

One module per operator; ``queries`` registers a query for each. Nothing outside this folder imports it.
"""
