"""tidemark: entity synchronisation and identity analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns a lazy DataFrame.  Physical choices (broadcast or shuffle join, skew
splitting, partition counts) are left to Catalyst and adaptive execution; the operators only shape the logical plan
so that those choices stay open and no group has to fit into one task.
"""
