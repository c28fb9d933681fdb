"""Image-study analytics as Spark DataFrame plans."""
