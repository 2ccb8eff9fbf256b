"""pagetrawl: page archives to a deduplicated catalogue, as Spark DataFrames."""
