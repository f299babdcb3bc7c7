"""Comparable-area panel analytics on Spark.

Every operator is a plain function from DataFrame to DataFrame that can be
used with ``DataFrame.transform``.  Nothing here collects data: driver code
only resolves column names and configuration.
"""

__version__ = "0.1.0"
