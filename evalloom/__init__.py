"""evalloom: evaluation logs and document corpora as Spark DataFrames, from raw text to decision."""
