"""millrace: news-recommendation analytics as Spark DataFrame operators."""
