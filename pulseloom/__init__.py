"""Signal-to-incident analytics as Spark DataFrame operators."""
