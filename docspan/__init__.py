"""docspan: document-extraction analytics as Spark DataFrame operators."""
