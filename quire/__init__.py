"""quire: PDF files as Spark tables."""
