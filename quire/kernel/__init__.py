"""The byte kernel: what is sequential in a PDF file, in plain Python. No Spark in here."""
