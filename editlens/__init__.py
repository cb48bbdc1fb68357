"""editlens: edit-history analytics and corpus preparation on Spark DataFrames."""
