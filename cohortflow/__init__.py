"""cohortflow: user bucketing and experiment assignment as Spark jobs."""
