"""Reference-sample and model-comparison analytics as Spark DataFrame operators."""
