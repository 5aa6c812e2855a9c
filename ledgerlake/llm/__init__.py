"""Operators for training-data pipelines: decontamination, archives, dedup, scoring, mixing.

Nothing outside this subpackage imports it; ``ledgerlake.llm.entries`` registers its queries.
"""
