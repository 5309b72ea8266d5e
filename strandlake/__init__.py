"""strandlake: analytics over reasoning traces and training corpora, on Spark DataFrames."""
