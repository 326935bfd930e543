"""docugrain: document-review analytics expressed as Spark DataFrame operators."""
