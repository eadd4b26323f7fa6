"""Session analytics on Spark: corpora, co-visitation graphs, candidates, features and evaluation."""
