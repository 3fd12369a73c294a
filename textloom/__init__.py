"""Text search and relevance analytics as Spark DataFrame plans."""
