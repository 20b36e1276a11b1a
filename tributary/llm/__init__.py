"""Training-data operators (language id, scans, tokenising, packing, near duplicates, search, sharding).

Nothing outside this package imports it; ``queries`` holds the registered queries.
"""
