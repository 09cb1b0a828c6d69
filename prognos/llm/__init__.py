"""Training-data pipeline operators: ten Spark jobs over documents, pages and embeddings."""
