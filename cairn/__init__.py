"""cairn: review analytics as DataFrame-to-DataFrame functions on Apache Spark."""
