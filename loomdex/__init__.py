"""loomdex: incremental document indexing and hybrid retrieval on PySpark."""

__version__ = "0.1.0"
