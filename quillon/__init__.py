"""quillon: decision-data analytics and corpus preparation on Spark DataFrames."""
