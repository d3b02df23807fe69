"""All queries of the library outside the training-data package, and the SQL that they are compared with."""

from __future__ import annotations

from .plans import draft_plans, evaluation_plans, language_plans, operation_plans, page_plans, read_plans, rule_plans, scheme_plans, search_plans, session_plans, structure_plans, text_plans

_PLANS = (rule_plans, read_plans, text_plans, search_plans, operation_plans, evaluation_plans, draft_plans, page_plans, structure_plans, session_plans, language_plans, scheme_plans)
QUERIES = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
ORACLE_SQL = {k: s for p in _PLANS for k, s in p.ORACLE_SQL.items()}
FLAGSHIP = rule_plans.rule_eval_status
