"""tidemark: Spark-native operators for price series, support tickets and labelled text.

Every operator takes and returns DataFrames; fits return small DataFrames that are
joined back. See README.md for the operator map.
"""

__version__ = "0.1.0"
