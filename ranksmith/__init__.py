"""ranksmith: Spark-native preparation and evaluation of text-retrieval data.

Every public operator is a ``DataFrame -> DataFrame`` function meant to be
chained with ``DataFrame.transform``; none creates a SparkSession.
"""

__version__ = "0.1.0"
