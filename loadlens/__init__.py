"""loadlens: workload and measurement analytics on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame.  ``functions`` holds
column expressions and the shared building blocks, ``sources`` the readers and
writers, ``operators`` the batch operators, ``streaming`` the Structured
Streaming ones and ``plans`` the registered queries with their SQL checks.
"""
