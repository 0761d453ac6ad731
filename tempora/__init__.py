"""Region-activity and rhythm analytics as Spark DataFrame transformations."""
