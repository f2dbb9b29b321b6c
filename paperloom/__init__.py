"""paperloom: document analytics and retrieval as plain Spark DataFrame functions."""
