"""Credit-scoring analytics on Spark DataFrames.

Sub-packages: ``sources`` (readers, sinks, column contracts, the wide user table), ``functions`` (column
expressions), ``operators`` (features, scaling, models, evaluation, composition, profiling) and ``plans``
(the end-to-end scoring plan and the query catalogue).
"""
