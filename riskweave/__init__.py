"""Code-security findings analytics on Spark."""
