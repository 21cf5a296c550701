"""millrace: posting analytics as Spark DataFrame plans."""
