"""loomset: a Spark-first engine for co-occurrence embeddings, retrieval and the tables around them."""
