"""A multi-version key/value analytics engine on Spark."""
