"""quakespark: aftershock, exposure and association analysis as Spark jobs."""
