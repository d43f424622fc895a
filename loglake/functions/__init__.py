"""Column functions: codecs, time rendering, text predicates."""
