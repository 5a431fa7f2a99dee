"""clausewright: a PySpark-native engine for catalogues of regulatory and technical documents."""

__version__ = "0.1.0"
