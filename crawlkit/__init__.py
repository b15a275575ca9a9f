"""crawlkit: crawl-data operators for Spark DataFrames and streams."""
