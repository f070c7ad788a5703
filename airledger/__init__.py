"""Source attribution on sensor time series as Spark jobs over long tables."""
