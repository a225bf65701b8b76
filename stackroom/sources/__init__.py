"""Reading and writing of the library's tables."""
