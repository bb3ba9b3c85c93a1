"""Spark-native handling of point observations that are uncertain in age.

``functions`` holds column expressions, ``operators`` holds joins, windows and
aggregations over DataFrames, ``sources`` holds readers and writers, ``plans``
holds the user-facing jobs, and ``catalog`` binds the operators to the driver's
test tables.
"""

__version__ = "0.1.0"
