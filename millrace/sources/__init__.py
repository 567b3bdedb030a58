"""Tables in and out of Spark."""
