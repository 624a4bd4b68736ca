"""subsieve: choose and audit small representative subsets with Spark DataFrames."""
