"""vellum: evidence-first document analytics expressed as Spark DataFrame plans."""
