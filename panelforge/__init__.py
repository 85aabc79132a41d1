"""Portfolio risk analytics and corpus operators on Spark DataFrames."""
