"""Evidence-traceable document analytics as Spark DataFrame operators."""
