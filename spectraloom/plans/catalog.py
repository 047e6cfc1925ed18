"""All queries outside the llm subpackage."""

from spectraloom.plans import compare_queries, correction_queries, downstream_queries, fdr_queries, packed_queries, psm_queries, record_queries, source_queries

_MODULES = (packed_queries, fdr_queries, psm_queries, compare_queries, correction_queries, downstream_queries, source_queries, record_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
