"""Training-data operators: tokenising, packing, duplicates, language, search, archives.

Nothing outside this package imports it; ``queries`` in this package lists what it offers
to the entry module.
"""
