"""Training-data operators: media columns, near-duplicates, rules, mixing, packing, archives.

Nothing outside this folder imports it; ``queries.py`` registers one query per operator.
"""
