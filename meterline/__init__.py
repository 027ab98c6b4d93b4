"""Cost, routing, drift and dataset analytics over model-traffic logs, as Spark jobs."""
