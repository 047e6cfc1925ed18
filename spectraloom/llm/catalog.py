"""All queries of the llm subpackage."""

from spectraloom.llm import language_queries, leakage_queries, packing_queries, quantiles_queries, setjoin_queries, spans_queries, topn_queries

_MODULES = (setjoin_queries, topn_queries, spans_queries, quantiles_queries, packing_queries, leakage_queries, language_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
