"""siftlake: source-audit analytics as Spark DataFrame and Structured Streaming operators."""
