"""Names, plans and SQL of the registered queries."""

from __future__ import annotations

from clinflow.plans import cohort_queries, comparator_queries, evaluation_queries, selection_queries, source_queries, table_queries

FLAGSHIP = "landmark_risk_set"
QUERIES = table_queries.QUERIES | cohort_queries.QUERIES | evaluation_queries.QUERIES | selection_queries.QUERIES | comparator_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL = table_queries.ORACLE_SQL | cohort_queries.ORACLE_SQL | evaluation_queries.ORACLE_SQL | selection_queries.ORACLE_SQL | comparator_queries.ORACLE_SQL | source_queries.ORACLE_SQL
