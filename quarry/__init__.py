"""quarry: a Spark-native engine for multi-level data-quality analytics.

Every operator is a plain function that takes and returns Spark DataFrames
(or Columns).  Nothing is collected to the driver except one-row aggregates
whose size is fixed by construction.
"""

__version__ = "0.1.0"
