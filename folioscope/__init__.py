"""Document corpora, knowledge graphs and hybrid search as Spark DataFrames."""
