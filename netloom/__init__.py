"""netloom: spatial-network analytics over cohorts, expressed as Spark plans."""
