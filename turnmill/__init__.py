"""turnmill: analytics over conversational memory data, written for Spark."""
