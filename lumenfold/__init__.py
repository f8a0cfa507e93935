"""lumenfold: media-catalog synchronisation and exact vector search as PySpark jobs."""
