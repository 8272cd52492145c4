"""All queries of the core, by name."""

from strandlake.plans import format_queries, general_queries, genomic_queries, orphan_queries, record_queries

_MODULES = (orphan_queries, general_queries, genomic_queries, record_queries, format_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
FLAGSHIP = "j0_reads_per_feature"
