"""Template mining and pattern coverage for message corpora, as Spark plans."""
