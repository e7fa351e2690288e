"""Profile, repair, summarise and score tables with plain Spark DataFrames.

``functions`` build ``Column`` expressions, ``operators`` take and return
DataFrames, ``sources`` read and publish, ``plans`` bind the operators to the
test tables and pair each with its SQL check.
"""
