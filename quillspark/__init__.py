"""quillspark: document-corpus analytics on Spark DataFrames."""
