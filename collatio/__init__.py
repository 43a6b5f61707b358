"""collatio: evaluation of text transcriptions at scale, on Spark DataFrames."""
