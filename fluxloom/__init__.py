"""Template-fitting photometry on Spark."""
