"""Cycling-telemetry analytics as Spark jobs.

Every public operator is a function from DataFrame to DataFrame.  ``sources`` reads and
writes tables, ``functions`` holds column helpers, ``operators`` the jobs, and ``plans``
the registered queries with their SQL counterparts.
"""
