"""Token-launch fraud analytics as Spark DataFrame operators."""
