"""docmill: document-analytics engine on Spark DataFrames."""
