"""Spark-native operators for bibliographic corpora.

Every public operator takes and returns DataFrames (or Columns), so queries
stay lazy until the caller writes or collects them.
"""
