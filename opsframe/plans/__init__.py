"""Registered queries: importing this package registers all of them."""

from . import q_aggregates, q_functions, q_inventory, q_joins, q_kpi, q_latency, q_logs, q_promql, q_range, q_rule_specs, q_rules, q_select, q_signals, q_state, q_streams, q_trace, q_wire  # noqa: F401
