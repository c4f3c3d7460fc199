"""Political-money analytics on Spark."""
