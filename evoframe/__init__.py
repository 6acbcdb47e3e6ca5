"""Population analytics and corpus processing as Spark DataFrame plans."""
