"""tidemark: text-to-timeline analytics expressed as Spark DataFrames."""
