"""Content-addressed delta and reconcile work as Spark DataFrame operators."""
