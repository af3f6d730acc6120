"""Codecs of binary formats in plain Python: bytes in, dictionaries and lists out. Nothing here knows Spark."""
