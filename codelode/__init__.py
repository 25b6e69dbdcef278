"""Source repositories as data: a code-analytics engine on Spark DataFrames."""
