"""Training-data operators: media, text quality, dedup, mixing and storage.

Nothing outside this subpackage imports it.
"""
