"""Frame-sequence and labelled-point analytics as Spark DataFrame operators."""
