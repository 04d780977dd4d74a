"""Audio-library analytics and corpus preparation on Spark."""
