"""Training-data operators: ten independent Spark jobs over text, page and vector tables."""
