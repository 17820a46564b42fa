"""veritext: Spark jobs that build, check, deduplicate and score labelled text datasets."""
