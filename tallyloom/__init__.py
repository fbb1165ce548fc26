"""A PySpark engine that reconciles schemas across data stores."""
