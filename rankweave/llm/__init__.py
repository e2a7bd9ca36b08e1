"""Training-data operators: media, tokenisation, mixing, archives, cleaning, scoring, sharding and near duplicates.

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
