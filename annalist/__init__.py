"""annalist: temporal knowledge retrieval and corpus preparation on Spark DataFrames."""
