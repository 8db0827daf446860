"""Training-data operators: packing, token counts, quality, toxicity, URL
rules, quotation threads, near-duplicates, decontamination, id storage.

Nothing outside this package imports it; ``queries.py`` registers the keys.
"""
