"""Training-data operators: tokenisation, extraction, scanning, dedup, mixing, sharding.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
