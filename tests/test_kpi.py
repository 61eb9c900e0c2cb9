"""The catalogue of database indicators by hand, and its plan."""

import math

import pytest

from opsframe.operators import kpi
from opsframe.plans import q_kpi

AT = 10_000 * 1_000_000
SCHEMA = "source string, name string, labels map<string,string>, t long, value double"


def counter(name, per_second, labels=None, source="s", seconds=900):
    """A sample a minute over the last quarter of an hour, from 1000."""
    return [(source, name, labels or {}, AT - (seconds - k) * 1_000_000, 1000.0 + per_second * k) for k in range(0, seconds + 1, 60)]


def gauge(name, value, labels=None, source="s", age=10):
    return [(source, name, labels or {}, AT - age * 1_000_000, value)]


def got(spark, rows):
    out = kpi.evaluate(spark.createDataFrame(rows, SCHEMA), ["source"], AT).collect()
    return {(r["source"], r["db"], r["kpi"]): (round(r["value"], 6), r["code"], r["severity"]) for r in out}


def test_forms(spark):
    rows = gauge("mysql_global_status_threads_connected", 80.0, {"i": "1"}) + gauge("mysql_global_status_threads_connected", 40.0, {"i": "2"}) + gauge("mysql_global_variables_max_connections", 100.0)
    rows += counter("mysql_global_status_innodb_buffer_pool_reads", 8) + counter("mysql_global_status_innodb_buffer_pool_read_requests", 60, {"a": "1"}) + counter("mysql_global_status_innodb_buffer_pool_read_requests", 40, {"a": "2"})
    rows += counter("mysql_global_status_aborted_clients", 1) + counter("pg_stat_database_xact_rollback", 1) + counter("pg_stat_database_xact_commit", 9) + gauge("mongodb_ss_mem_resident", 2.0)
    rows += counter("mongodb_ss_opLatencies_latency", 120_000) + counter("mongodb_ss_opLatencies_ops", 2)
    out = {k[2]: v for k, v in got(spark, rows).items()}
    assert out["current_connections"] == (80.0, None, None) and out["connection_usage_pct"] == (80.0, "mysql_connection_pressure", "warning")
    assert out["innodb_buffer_pool_hit_pct"] == (92.0, "mysql_innodb_buffer_pool_hit_low", "warning")
    assert out["aborted_clients_15m"] == (900.0, "mysql_aborted_clients", "critical") and out["rollback_ratio_pct"] == (10.0, "postgresql_rollback_ratio", None)
    assert out["resident_memory_bytes"][0] == 2 * 1024**2 and out["operation_latency_ms"] == (60.0, "mongodb_operation_latency", "warning")


def test_label_sets_and_conditions(spark):
    size = "mysql_info_schema_table_size_data_length"
    rows = [r for s, t, i in (("a", "x", "1"), ("a", "x", "2"), ("a", "y", "1"), ("b", "x", "1")) for r in gauge(size, 5.0, {"schema": s, "table": t, "instance": i})]
    rows += gauge(size, 5.0, {"schema": "old", "table": "z"}, age=400)  # no newer sample: not there at this moment
    rows += gauge("mongodb_ss_connections", 700.0, {"conn_type": "current"}) + gauge("mongodb_ss_connections", 9.0, {"conn_type": "available"}) + gauge("mongodb_connections", 5000.0, {"state": "current"})
    rows += gauge("redis_db_keys", 5.0, {"db": "0"}) + gauge("redis_db_keys", 7.0, {"db": "1"})
    out = {k[2]: v for k, v in got(spark, rows).items()}
    assert out["schema_count"][0] == 2 and out["table_count"][0] == 3 and out["logical_database_count"][0] == 2 and out["key_count"][0] == 12
    assert out["connections_current"] == (700.0, "mongodb_connection_pressure", "warning") and out["connections_available"][0] == 9.0


def test_second_choices_missing_parts_and_limits(spark):
    rows = gauge("mongodb_connections", 5000.0, {"state": "current"}) + gauge("mysql_info_schema_table_size_index_length", 1.0, {"schema": "a", "table": "x"}) + gauge("mysql_up", 0.0)
    rows += gauge("redis_mem_fragmentation_ratio", 9.0) + gauge("redis_memory_used_bytes", 1000.0) + gauge("redis_memory_max_bytes", 0.0) + gauge("redis_connected_clients", 3.0) + gauge("pg_up", 1.0)
    rows += gauge("redis_mem_fragmentation_ratio", 1.7, source="other")
    out = got(spark, rows)
    assert out["s", "mongodb", "connections_current"] == (5000.0, "mongodb_connection_pressure", "critical") and out["s", "mysql", "schema_count"][0] == 1
    assert out["s", "mysql", "mysql_up"] == (0.0, "mysql_up_down", "critical") and out["s", "postgresql", "pg_up"] == (1.0, "pg_up_down", None)
    assert out["s", "redis", "mem_fragmentation_ratio"][2] is None and out["other", "redis", "mem_fragmentation_ratio"][2] == "warning"
    assert ("s", "redis", "memory_usage_pct") not in out and ("s", "redis", "client_usage_pct") not in out


def test_no_samples(spark):
    rows = [("s", "redis_db_keys", {}, AT, None), ("s", "redis_db_keys", {}, AT - 1, math.nan), ("s", "unknown", {}, AT, 1.0), ("s", "redis_up", {}, AT + 1, 1.0), ("s", "redis_up", {}, AT - 901_000_000, 1.0)]
    assert got(spark, rows) == {} and got(spark, []) == {}


def test_counters_fall_and_start_again(spark):
    rows = counter("redis_evicted_keys_total", 1)
    rows[8:] = [(s, n, lab, t, v - rows[8][4]) for s, n, lab, t, v in rows[8:]]
    assert got(spark, rows)["s", "redis", "evicted_keys_15m"][0] == pytest.approx(840.0)


def test_one_scan(spark):
    """All expressions come from one read of the samples and one exchange of them."""
    plan = kpi.evaluate(q_kpi.samples(spark, "/root/testdata/sf0.001"), ["source"], AT)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("FileScan") == 1 and initial.count("Exchange hashpartitioning") == 3 and "Join" not in initial
    assert len(kpi.CATALOGUE) > 100 and len({(k.db, k.name, k.instead_of) for k in kpi.CATALOGUE}) == len(kpi.CATALOGUE)
    assert str(kpi.CATALOGUE[1].parts[0]) == "max(mysql_global_status_threads_connected)"
