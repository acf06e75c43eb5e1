"""sparkatlas: code-intelligence analytics on Spark DataFrames."""
