"""The library's queries over the given tables."""
