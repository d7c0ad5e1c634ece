"""postmill: feed-post enrichment, stored-query matching, ranked search and time-bucket analytics on PySpark."""
