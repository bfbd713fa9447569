"""Signal analytics on Spark: scoring, correlation, graphs, text and cases as DataFrame jobs."""
