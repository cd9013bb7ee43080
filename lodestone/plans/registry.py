"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from lodestone.plans import adapter_queries, align_queries, convert_queries, curate_queries, group_queries, loss_queries, prepare_queries, problem_queries, replay_queries, response_queries, sample_queries, state_queries, token_queries, user_queries

_MODULES = (adapter_queries, align_queries, convert_queries, curate_queries, group_queries, loss_queries, prepare_queries, problem_queries, replay_queries, response_queries, sample_queries, state_queries, token_queries, user_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
