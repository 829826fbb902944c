"""Training-data operators: filtering, de-duplication, scoring and encoding of text corpora.

Nothing outside this subpackage imports it.
"""
