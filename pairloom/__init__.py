"""Parallel-corpus preparation, orthography and translation scoring on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` function; only the sinks and the
``require_*`` guards run a job.
"""
