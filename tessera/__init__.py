"""A PySpark engine for retrieval analytics over documents."""
