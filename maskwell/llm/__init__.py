"""Training-data operators: dedup, language ID, formatting, scans, mixing and tokenization.

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
