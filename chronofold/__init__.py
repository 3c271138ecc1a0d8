"""Journal analytics for durable workflow runs, written for Spark."""
