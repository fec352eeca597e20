"""Weekly hospital-capacity analytics on Spark."""
