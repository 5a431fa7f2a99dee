"""Registered queries by family."""


def all_queries() -> dict:
    """Every core query by name."""
    from . import assembly, catalog, documents, ingestion, retrieval

    return catalog.QUERIES | documents.QUERIES | retrieval.QUERIES | ingestion.QUERIES | assembly.QUERIES


def all_sql() -> dict[str, str]:
    """The SQL of the core queries that have one."""
    from . import assembly, catalog, documents, ingestion, retrieval

    return catalog.SQL | documents.SQL | retrieval.SQL | ingestion.SQL | assembly.SQL
