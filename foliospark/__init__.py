"""foliospark: document-findings analytics expressed as Spark DataFrame plans."""
