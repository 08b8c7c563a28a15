"""cellweave: grid-recognition scoring, cleaning and curation as Spark DataFrame plans."""
