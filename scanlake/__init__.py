"""scanlake: vulnerability-findings analytics as Spark DataFrame operators."""
