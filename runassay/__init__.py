"""runassay: evaluation of generated answers as Spark jobs."""
