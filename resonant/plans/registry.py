"""Every registered query of the engine with its DuckDB counterpart."""

from . import retrieval, storage, texts, vectors

QUERIES = {**retrieval.QUERIES, **texts.QUERIES, **vectors.QUERIES, **storage.QUERIES}
ORACLE_SQL = {**retrieval.ORACLE_SQL, **texts.ORACLE_SQL, **vectors.ORACLE_SQL, **storage.ORACLE_SQL}
