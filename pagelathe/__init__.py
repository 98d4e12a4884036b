"""Web-page analytics on Spark: pages, crawls and their reports as DataFrames."""
