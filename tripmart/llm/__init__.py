"""Training-data operators: cleaning, near-duplicates, decontamination, packing.

Nothing outside this subpackage imports it. ``queries.QUERIES`` and
``queries.ORACLES`` hold what ``__spark_entry__`` registers.
"""
