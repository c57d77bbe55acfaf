"""vellum: document analytics as PySpark DataFrame operators."""
