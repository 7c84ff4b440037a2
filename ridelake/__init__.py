"""Ride-hailing trip analytics on Spark.

Layers: ``functions`` (Column to Column), ``operators`` (DataFrame to
DataFrame, lazy), ``ml`` (Spark ML), ``streaming`` (Structured Streaming),
``sources`` (readers and writers), ``plans`` (the jobs and registered queries).
"""
