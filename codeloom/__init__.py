"""codeloom: qualitative-coding analytics and text data processing on Spark DataFrames.

Every operator takes DataFrames (and small configuration objects) and returns lazy
DataFrames. No operator keeps global state; nothing is collected to the driver except
results whose size is bounded by configuration and checked.
"""
