"""millrace: claims, emissions, vector and text analytics as Spark jobs."""
