"""Post-training data and reward analytics on Spark."""
