"""Training-data operators: tokenising, chat formatting, deduplication, scoring, decontamination, mixing.

Nothing outside this subpackage imports it.
"""
