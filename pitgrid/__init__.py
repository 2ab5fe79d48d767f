"""Point-in-time cross-sectional analytics as Spark DataFrame operators."""
