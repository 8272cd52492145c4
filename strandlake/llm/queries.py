"""All queries of the llm subpackage, by name."""

from strandlake.llm import domain_queries, text_queries

_MODULES = (domain_queries, text_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
