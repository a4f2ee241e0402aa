"""quillspark: curation, retrieval and tracking of noisy text captions on Spark DataFrames."""
