"""boxkit: box annotations, tracks, embeddings and survey metadata as Spark DataFrames."""
