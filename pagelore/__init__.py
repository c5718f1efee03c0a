"""pagelore: document retrieval and Q&A analytics as PySpark DataFrame functions."""
