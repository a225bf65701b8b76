"""stackroom: a document library's data work, expressed as Spark jobs.

Public functions take DataFrames and return DataFrames.  Nothing here collects
rows to the driver, and every expression is a Spark built-in (no Python UDFs).
"""

__version__ = "0.1.0"
