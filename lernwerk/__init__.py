"""Question-bank processing and learning analytics on Spark DataFrames."""
