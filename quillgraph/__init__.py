"""Knowledge-graph search and analytics as PySpark DataFrame operators."""
