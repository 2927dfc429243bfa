"""Star-rating analytics as Spark DataFrame jobs.

Sub-packages: ``sources`` (readers, writers), ``functions`` (column expressions),
``operators`` (DataFrame in, DataFrame out), ``plans`` (whole jobs) and ``queries``
(the checked query registry).
"""
