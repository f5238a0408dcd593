"""Network-visibility analytics as Spark DataFrame operators."""
