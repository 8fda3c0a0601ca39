"""kindred: near-duplicate detection and representative selection as Spark DataFrame plans."""
