"""Query-conditioned context analytics as DataFrame and Spark SQL operators."""
