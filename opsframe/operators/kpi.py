"""Indicators of databases: a catalogue of expressions, all computed by one scan and one aggregation of series.

A part of an expression is an aggregate over the series of one metric, like sum(rate(m[5m])), max(m) or count(count by
(a, b) (m)); an expression combines two or three parts. All series are read once: one lag by series serves every
window, one aggregation gives each series its newest value and its increases, and two more, over ever fewer rows,
the parts and the expressions. An expression without samples for a part gives no row, as missing isn't zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import Check, severity
from .range import LOOKBACK, SECOND, Grid, _before, _extrapolated

RATE, INCREASE = 300 * SECOND, 900 * SECOND


@dataclass(frozen=True)
class Part:
    """how: max, min or sum of the newest values, sum of rates (5 minutes) or increases (15 minutes), or count of the label sets of `by`."""

    how: str
    metric: str
    by: tuple[str, ...] = ()
    where: tuple[tuple[str, str], ...] = ()

    def __str__(self) -> str:
        m = self.metric + ("{" + ",".join(f'{k}="{v}"' for k, v in self.where) + "}" if self.where else "")
        return {"rate": f"sum(rate({m}[5m]))", "increase": f"sum(increase({m}[15m]))", "count": f"count(count by ({', '.join(self.by)}) ({m}))"}.get(self.how, f"{self.how}({m})")


@dataclass(frozen=True)
class Kpi:
    """form: plain a, or scaled `scale * a`; percent 100 a / max(b, 1); rest 100 (1 - a / max(b, 1)); share 100 a / max(a + b, 1); per `scale * a / max(b, 1)`.

    strict: share and percent as they stand in a check by hand: 100 a / (a + b) or 100 a / b, and no value where the
    denominator isn't above zero. least: (part, value) below which a limit says nothing. instead_of: metrics of which any makes this expression the second choice.
    """

    db: str
    name: str
    form: str
    parts: tuple[Part, ...]
    code: str | None = None
    scale: float = 1.0
    strict: bool = False
    least: tuple[Part, float] | None = None
    instead_of: tuple[str, ...] = ()
    warning_above: float | None = None
    critical_above: float | None = None
    warning_below: float | None = None
    critical_below: float | None = None

    def every(self) -> tuple[Part, ...]:
        return (*self.parts, *((self.least[0],) if self.least else ()))


def _of(db: str):
    def kpi(name: str, how: str, metric: str, code: str | None = None, warn: float | None = None, crit: float | None = None, **more) -> Kpi:
        return Kpi(db, name, "plain", (Part(how, metric, more.pop("by", ()), more.pop("where", ())),), code and f"{db}_{code}", warning_above=warn, critical_above=crit, **more)

    return kpi


def _ratio(db: str, name: str, form: str, a: Part, b: Part, code: str | None, **more) -> Kpi:
    return Kpi(db, name, form, (a, b), code and f"{db}_{code}", **more)


def _up(db: str, *metrics: str) -> list[Kpi]:
    """Whether the database answers: the first of the metrics that there is."""
    return [Kpi(db, m, "plain", (Part("min", m),), f"{m}_down", critical_below=5e-324, instead_of=metrics[:i]) for i, m in enumerate(metrics)]


_my, _pg, _rd, _mg = _of("mysql"), _of("postgresql"), _of("redis"), _of("mongodb")
_S, _V = "mysql_global_status_", "mysql_global_variables_"
_SS = "mongodb_ss_"
_SIZE = "mysql_info_schema_table_size_data_length", "mysql_info_schema_table_size_index_length"

#: Metrics, windows and limits of the indicators.
CATALOGUE: tuple[Kpi, ...] = (
    *_up("mysql", "mysql_up"),
    _my("current_connections", "max", _S + "threads_connected"),
    _my("max_connections", "max", _V + "max_connections"),
    _my("threads_running", "max", _S + "threads_running"),
    _my("max_used_connections", "max", _S + "max_used_connections"),
    _my("queries_per_second", "rate", _S + "questions"),
    _my("network_received_bytes_per_second", "rate", _S + "bytes_received"),
    _my("network_sent_bytes_per_second", "rate", _S + "bytes_sent"),
    _ratio("mysql", "connection_usage_pct", "percent", Part("max", _S + "threads_connected"), Part("max", _V + "max_connections"), "connection_pressure", warning_above=75, critical_above=90),
    _my("slow_queries_per_second", "rate", _S + "slow_queries", "slow_queries", 0.1, 1),
    _my("aborted_connects_15m", "increase", _S + "aborted_connects", "aborted_connects", 0),
    _my("aborted_clients_15m", "increase", _S + "aborted_clients", "aborted_clients", 10, 100),
    _my("connection_errors_15m", "increase", _S + "connection_errors_total", "connection_errors", 0, 10),
    _my("tmp_disk_tables_15m", "increase", _S + "created_tmp_disk_tables", "tmp_disk_tables", 100, 1000),
    _ratio("mysql", "innodb_buffer_pool_hit_pct", "rest", Part("rate", _S + "innodb_buffer_pool_reads"), Part("rate", _S + "innodb_buffer_pool_read_requests"), "innodb_buffer_pool_hit_low", warning_below=95, critical_below=90),
    _my("innodb_row_lock_current_waits", "max", _S + "innodb_row_lock_current_waits", "innodb_row_lock_waiting", 0),
    _my("innodb_row_lock_waits_15m", "increase", _S + "innodb_row_lock_waits", "innodb_row_lock_waits", 10, 100),
    _ratio("mysql", "open_files_usage_pct", "percent", Part("max", _S + "open_files"), Part("max", _V + "open_files_limit"), "open_files_pressure", warning_above=75, critical_above=90),
    _my("opened_tables_15m", "increase", _S + "opened_tables", "opened_tables", 1000, 10000),
    _my("table_open_cache_overflows_15m", "increase", _S + "table_open_cache_overflows", "table_open_cache_overflows", 0, 10),
    _my("table_locks_waited_15m", "increase", _S + "table_locks_waited", "table_locks_waited", 0, 10),
    _my("select_full_join_15m", "increase", _S + "select_full_join", "select_full_join", 0, 100),
    _my("sort_merge_passes_15m", "increase", _S + "sort_merge_passes", "sort_merge_passes", 100, 1000),
    _my("innodb_log_waits_15m", "increase", _S + "innodb_log_waits", "innodb_log_waits", 0, 10),
    _my("binlog_cache_disk_use_15m", "increase", _S + "binlog_cache_disk_use", "binlog_cache_disk_use", 0, 10),
    _my("schema_count", "count", _SIZE[0], by=("schema",)),
    _my("table_count", "count", _SIZE[0], by=("schema", "table")),
    _my("schema_count", "count", _SIZE[1], by=("schema",), instead_of=_SIZE[:1]),
    _my("table_count", "count", _SIZE[1], by=("schema", "table"), instead_of=_SIZE[:1]),
    *_up("postgresql", "pg_up"),
    _pg("current_connections", "sum", "pg_stat_activity_count"),
    _pg("max_connections", "max", "pg_settings_max_connections"),
    _pg("database_size_bytes", "sum", "pg_database_size_bytes"),
    _pg("locks_count", "sum", "pg_locks_count"),
    _ratio("postgresql", "connection_usage_pct", "percent", Part("sum", "pg_stat_activity_count"), Part("max", "pg_settings_max_connections"), "connection_pressure", warning_above=75, critical_above=90),
    _pg("deadlocks_15m", "increase", "pg_stat_database_deadlocks", "deadlocks", 0, 3),
    _ratio("postgresql", "rollback_ratio_pct", "share", Part("rate", "pg_stat_database_xact_rollback"), Part("rate", "pg_stat_database_xact_commit"), "rollback_ratio", warning_above=10, critical_above=30),
    _ratio("postgresql", "cache_hit_ratio_pct", "share", Part("rate", "pg_stat_database_blks_hit"), Part("rate", "pg_stat_database_blks_read"), "cache_hit_low", warning_below=95, critical_below=90),
    _pg("temp_bytes_15m", "increase", "pg_stat_database_temp_bytes", "temp_bytes", 1024**3, 10 * 1024**3),
    _pg("conflicts_15m", "increase", "pg_stat_database_conflicts", "conflicts", 0, 10),
    _pg("replication_lag_seconds", "max", "pg_replication_lag_seconds", "replication_lag", 30, 300),
    _pg("exporter_last_scrape_error", "max", "pg_exporter_last_scrape_error", "exporter_scrape_error", 0, 0),
    _pg("max_tx_duration_seconds", "max", "pg_stat_activity_max_tx_duration", "long_transaction", 300, 1800),
    _pg("archiver_failures_15m", "increase", "pg_stat_archiver_failed_count", "archiver_failures", 0, 3),
    _pg("requested_checkpoints_15m", "increase", "pg_stat_bgwriter_checkpoints_req_total", "requested_checkpoints", 0),
    _pg("database_count", "count", "pg_database_size_bytes", by=("datname",)),
    _pg("table_count", "count", "pg_stat_user_tables_n_live_tup", by=("schemaname", "relname")),
    *_up("redis", "redis_up"),
    _rd("connected_clients", "max", "redis_connected_clients"),
    _rd("max_clients", "max", "redis_config_maxclients"),
    _rd("commands_per_second", "rate", "redis_commands_processed_total"),
    _rd("network_input_bytes_per_second", "rate", "redis_net_input_bytes_total"),
    _rd("network_output_bytes_per_second", "rate", "redis_net_output_bytes_total"),
    _rd("connected_slaves", "max", "redis_connected_slaves"),
    _rd("rdb_changes_since_last_save", "max", "redis_rdb_changes_since_last_save"),
    _ratio("redis", "client_usage_pct", "percent", Part("max", "redis_connected_clients"), Part("max", "redis_config_maxclients"), "client_pressure", warning_above=75, critical_above=90),
    _rd("evicted_keys_15m", "increase", "redis_evicted_keys_total", "evictions", 0),
    _rd("rejected_connections_15m", "increase", "redis_rejected_connections_total", "rejected_connections", 0, 0),
    _rd("expired_keys_15m", "increase", "redis_expired_keys_total"),
    _rd("blocked_clients", "max", "redis_blocked_clients", "blocked_clients", 0),
    _rd("slowlog_length", "max", "redis_slowlog_length", "slowlog", 0),
    _rd("exporter_last_scrape_error", "max", "redis_exporter_last_scrape_error", "exporter_scrape_error", 0, 0),
    _rd("error_replies_15m", "increase", "redis_total_error_replies", "error_replies", 0, 100),
    _rd("command_failures_15m", "increase", "redis_commands_failed_calls_total", "command_failures", 0, 100),
    _rd("latest_fork_seconds", "max", "redis_latest_fork_seconds", "slow_fork", 1, 5),
    _rd("max_latency_usec", "max", "redis_latency_percentiles_usec", "high_latency", 100_000, 1_000_000),
    _rd("memory_used_bytes", "max", "redis_memory_used_bytes"),
    _rd("memory_max_bytes", "max", "redis_memory_max_bytes"),
    _ratio("redis", "memory_usage_pct", "percent", Part("max", "redis_memory_used_bytes"), Part("max", "redis_memory_max_bytes"), "memory_pressure", strict=True, warning_above=80, critical_above=90),
    _rd("mem_fragmentation_ratio", "max", "redis_mem_fragmentation_ratio", "memory_fragmentation", 1.5, 2, least=(Part("max", "redis_memory_used_bytes"), 64.0 * 1024 * 1024)),
    _rd("keyspace_hits_per_second", "rate", "redis_keyspace_hits_total"),
    _rd("keyspace_misses_per_second", "rate", "redis_keyspace_misses_total"),
    _ratio("redis", "keyspace_hit_ratio_pct", "share", Part("rate", "redis_keyspace_hits_total"), Part("rate", "redis_keyspace_misses_total"), "keyspace_hit_ratio_low", strict=True, warning_below=80, critical_below=50),
    _rd("logical_database_count", "count", "redis_db_keys", by=("db",)),
    _rd("key_count", "sum", "redis_db_keys"),
    *_up("mongodb", "mongodb_up"),
    _mg("connections_current", "max", _SS + "connections", "connection_pressure", 500, 1000, where=(("conn_type", "current"),)),
    _mg("connections_current", "max", "mongodb_connections", "connection_pressure", 500, 1000, where=(("state", "current"),), instead_of=(_SS + "connections",)),
    _mg("connections_available", "max", _SS + "connections", where=(("conn_type", "available"),)),
    _mg("connections_available", "max", "mongodb_connections", where=(("state", "available"),), instead_of=(_SS + "connections",)),
    _mg("operations_per_second", "rate", _SS + "opcounters"),
    _mg("operations_per_second", "rate", "mongodb_op_counters_total", instead_of=(_SS + "opcounters",)),
    _mg("asserts_15m", "increase", _SS + "asserts", "asserts", 0),
    _mg("asserts_15m", "increase", "mongodb_asserts_total", "asserts", 0, instead_of=(_SS + "asserts",)),
    _mg("page_faults_15m", "increase", _SS + "extra_info_page_faults", "page_faults", 0),
    _mg("page_faults_15m", "increase", _SS + "extra_info_page_faults_total", "page_faults", 0, instead_of=(_SS + "extra_info_page_faults",)),
    Kpi("mongodb", "resident_memory_bytes", "scaled", (Part("max", _SS + "mem_resident"),), scale=1048576.0),
    Kpi("mongodb", "resident_memory_bytes", "scaled", (Part("max", "mongodb_mongod_mem_resident_megabytes"),), scale=1048576.0, instead_of=(_SS + "mem_resident",)),
    _mg("feature_compatibility_version", "max", "mongodb_fcv_feature_compatibility_version"),
    _mg("network_in_bytes_per_second", "rate", _SS + "network_bytesIn"),
    _mg("network_out_bytes_per_second", "rate", _SS + "network_bytesOut"),
    _mg("connection_rate_limit_rejected_15m", "increase", _SS + "connections_establishmentRateLimit_rejected", "connection_rate_limit_rejected", 0, 10),
    _mg("global_lock_queue", "max", _SS + "globalLock_currentQueue", "global_lock_queue", 0, 10),
    _mg("flow_control_lagged", "max", _SS + "flowControl_isLagged", "flow_control_lagged", 0),
    _ratio("mongodb", "wiredtiger_cache_usage_pct", "percent", Part("max", _SS + "wt_cache_bytes_currently_in_the_cache"), Part("max", _SS + "wt_cache_maximum_bytes_configured"), "wiredtiger_cache_pressure", warning_above=80, critical_above=95),
    _ratio("mongodb", "wiredtiger_dirty_cache_pct", "percent", Part("max", _SS + "wt_cache_tracked_dirty_bytes_in_the_cache"), Part("max", _SS + "wt_cache_maximum_bytes_configured"), "wiredtiger_dirty_cache", warning_above=10, critical_above=20),
    _mg("wiredtiger_cache_timeouts_15m", "increase", _SS + "wt_cache_operations_timed_out_waiting_for_space_in_cache", "wiredtiger_cache_timeouts", 0, 10),
    _ratio("mongodb", "operation_latency_ms", "per", Part("rate", _SS + "opLatencies_latency"), Part("rate", _SS + "opLatencies_ops"), "operation_latency", scale=0.001, warning_above=50, critical_above=200),
    _mg("collection_scans_15m", "increase", _SS + "metrics_queryExecutor_collectionScans_total", "collection_scans", 0, 100),
    _mg("query_sort_spills_15m", "increase", _SS + "metrics_query_sort_spillToDisk", "query_sort_spills", 0, 10),
    _mg("cursor_timeouts_15m", "increase", _SS + "metrics_cursor_timedOut", "cursor_timeouts", 0, 100),
    _mg("transactions_current_open", "max", _SS + "transactions_currentOpen"),
    _mg("dbstats_data_size_bytes", "sum", "mongodb_dbstats_dataSize"),
    _mg("dbstats_free_storage_bytes", "sum", "mongodb_dbstats_freeStorageSize"),
    _mg("top_total_ops_per_second", "rate", "mongodb_top_total_count"),
    _mg("currentop_fsync_lock_state", "max", "mongodb_currentop_fsync_lock_state", "fsync_locked", 0),
    _mg("profile_slow_queries_15m", "increase", "mongodb_profile_slow_query_count", "profile_slow_queries", 0, 100),
    _mg("pbm_backup_configured", "max", "mongodb_pbm_cluster_backup_configured"),
    _mg("database_count", "count", "mongodb_dbstats_dataSize", by=("database",)),
    _mg("collection_count", "count", "mongodb_collstats_storageStats_count", by=("database", "collection")),
    _mg("object_count", "sum", "mongodb_dbstats_objects"),
)


def metrics(catalogue: Sequence[Kpi]) -> list[str]:
    return sorted({p.metric for k in catalogue for p in k.every()} | {m for k in catalogue for m in k.instead_of})


def _series(samples: DataFrame, keys: Sequence[str], at: int) -> DataFrame:
    """(keys, name, labels, last, rate, increase) of each series: one lag and one aggregation, over one exchange."""
    grids = {"rate": Grid.instant(at, RATE), "increase": Grid.instant(at, INCREASE)}
    seen = _before(samples.where(F.col("t").between(at - max(RATE, INCREASE, LOOKBACK), at)), [*keys, "name", "labels"], "t")
    made = [F.max_by("value", F.when(F.col("t") >= at - LOOKBACK, F.col("t"))).alias("last")]
    for how, g in grids.items():
        inside = F.col("t") >= at - g.window
        when = lambda c, inside=inside: F.when(inside, F.col(c))
        drop = inside & (F.col("__pt") >= at - g.window) & (F.col("value") < F.col("__pv"))
        made.append(F.struct(
            F.min(when("t")).alias("tf"), F.max(when("t")).alias("tl"), F.min_by("value", when("t")).alias("vf"), F.max_by("value", when("t")).alias("vl"),
            F.count(when("value")).alias("n"), F.sum(F.when(drop, F.col("__pv")).otherwise(0.0)).alias("resets"),
        ).alias(f"s_{how}"))
    out = seen.groupBy(*keys, "name", "labels").agg(*made).withColumn("at", F.lit(at))
    for how, g in grids.items():
        flat = out.select(*keys, "name", "labels", "at", *[c for c in out.columns if c not in (*keys, "name", "labels", "at", f"s_{how}")], f"s_{how}.*")
        out = flat.withColumn(how, _extrapolated(g, how == "rate")).drop("tf", "tl", "vf", "vl", "n", "resets")
    return out.drop("at")


def evaluate(samples: DataFrame, keys: Sequence[str], at: int, catalogue: Sequence[Kpi] = CATALOGUE) -> DataFrame:
    """(keys, db, kpi, code, value, severity) of each expression that has samples, from samples (keys, name, labels: map of strings, t, value).

    Instant parts take a series' newest sample of the last five minutes. Null values and NaN are no samples; a metric counts
    as there, for second choices, if any of its series has a sample in the last quarter of an hour. Every key column is part of a source's identity.
    """
    counted = {(p.metric, p.by) for k in catalogue for p in k.every() if p.by}
    chosen = {(p.metric, p.where) for k in catalogue for p in k.every() if p.where}
    # a series is told by all of its labels; maps can't be grouped by, so by their sorted entries
    some = samples.where(F.col("name").isin(metrics(catalogue)) & F.col("value").isNotNull() & ~F.isnan("value"))
    some = some.select(*keys, "name", F.array_sort(F.map_entries("labels")).alias("labels"), "t", "value")
    series = _series(some, keys, at)
    label = lambda name: F.get(F.filter("labels", lambda x: x["key"] == name), F.lit(0))["value"]

    def tag(pairs, of) -> Column:
        """Per metric what tells its series apart, for the expressions that need it."""
        out = F.lit(None).cast("string")
        for m, x in sorted(pairs):
            out = F.when(F.col("name") == m, of(x)).otherwise(out)
        return out

    longest = {}
    for m, by in counted:
        longest[m] = max(longest.get(m, ()), by, key=len)
    sets = tag([(m, by) for m, by in longest.items()], lambda by: F.to_json(F.struct(*[F.coalesce(label(b), F.lit("")).alias(b) for b in by])))
    picks = {}
    for m, where in chosen:
        picks.setdefault(m, set()).add(where)
    pick = tag([(m, tuple(sorted(w))) for m, w in picks.items()], lambda ws: F.coalesce(*[F.when(_all(w, label), F.lit(str(w))) for w in ws]))
    groups = series.select(*keys, "name", sets.alias("labelled"), pick.alias("picked"), "last", "rate", "increase")
    # sums of sums, extremes of extremes; an expression's label sets are few beside the series
    first = groups.groupBy(*keys, "name", "labelled", "picked").agg(
        F.max("last").alias("max"), F.min("last").alias("min"), F.sum("last").alias("sum"), F.sum("rate").alias("rate"), F.sum("increase").alias("increase"))
    seen_set = {}
    for m, by in sorted(counted):
        if by != longest[m]:
            seen_set[m, by] = F.to_json(F.struct(*[F.get_json_object("labelled", f"$.{b}").alias(b) for b in by]))
    parts: dict[Part, Column] = {}
    for p in dict.fromkeys(p for k in catalogue for p in k.every()):
        here = F.col("name") == p.metric
        if p.where:
            here = here & (F.col("picked") == str(p.where))
        if p.how == "count":
            # a shorter label list of the same metric needs its own distinct count; few sets, so exact
            parts[p] = F.count_if(here & F.col("last_set")) if p.by == longest[p.metric] else F.size(F.collect_set(F.when(here & F.col("last_set"), seen_set[p.metric, p.by])))
        else:
            parts[p] = {"max": F.max, "min": F.min}.get(p.how, F.sum)(F.when(here, F.col(p.how)))
    there = {m: F.max(F.when(F.col("name") == m, F.lit(True))) for m in sorted({m for k in catalogue for m in k.instead_of})}
    named = {p: f"p{i}" for i, p in enumerate(parts)}
    known = {m: f"m{i}" for i, m in enumerate(there)}
    wide = first.withColumn("last_set", F.col("sum").isNotNull()).groupBy(*keys).agg(*[c.alias(named[p]) for p, c in parts.items()], *[c.alias(known[m]) for m, c in there.items()])

    def get(p: Part) -> Column:
        return F.nullif(F.col(named[p]).cast("double"), F.lit(0.0)) if p.how == "count" else F.col(named[p])

    rows = []
    for k in catalogue:
        v = _value(k, [get(p) for p in k.parts])
        for m in k.instead_of:
            v = F.when(F.col(known[m]).isNull(), v)
        broken = severity(v, Check(k.name, "", "", warning_above=k.warning_above, critical_above=k.critical_above, warning_below=k.warning_below, critical_below=k.critical_below))
        if k.least:
            broken = F.when(F.coalesce(get(k.least[0]) < k.least[1], F.lit(False)), F.lit(None)).otherwise(broken)
        rows.append(F.struct(F.lit(k.db).alias("db"), F.lit(k.name).alias("kpi"), F.lit(k.code).cast("string").alias("code"), v.alias("value"), broken.alias("severity")))
    return wide.select(*keys, F.inline(F.array(*rows))).where("value is not null")


def _all(where: Sequence[tuple[str, str]], label) -> Column:
    out = F.lit(True)
    for k, v in where:
        out = out & (label(k) == v)
    return out


def _value(k: Kpi, x: list[Column]) -> Column:
    least = lambda c: F.greatest(c, F.lit(1.0))
    if k.form in ("plain", "scaled"):
        return x[0] * k.scale
    a, b = x
    if k.strict:
        whole = a + b if k.form == "share" else b
        return F.when(whole > 0, 100 * a / whole)
    # greatest() would skip a null: an expression without one of its parts has no value
    return F.when(b.isNotNull(), {
        "percent": lambda: 100 * a / least(b), "rest": lambda: 100 * (1 - a / least(b)), "share": lambda: 100 * a / least(a + b), "per": lambda: k.scale * a / least(b),
    }[k.form]())
