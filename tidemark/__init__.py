"""tidemark: record linkage, matching and analytics expressed as Spark plans."""
