"""Evidence tables for speech data as Spark jobs."""
