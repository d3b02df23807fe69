"""Three-valued rule matching and document analytics, expressed as Spark jobs."""
