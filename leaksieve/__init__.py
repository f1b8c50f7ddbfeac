"""Finding and redacting leaked credentials in text at scale, as Spark jobs."""
