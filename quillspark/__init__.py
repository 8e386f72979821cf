"""quillspark: record-corpus analytics as lazy PySpark DataFrames."""
