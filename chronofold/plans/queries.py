"""Registered queries of the splitters and what is built on them, each with DuckDB SQL written from the definition of the folds."""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import chronofold as cf
from chronofold.functions import features, metrics, models, regression
from chronofold.operators import keys as key_ops
from chronofold.operators.assign import time_bounds
from chronofold.operators.bounds import fold_bounds
from chronofold.operators.keys import Keys


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trunc(unit: str, column: str):
    return F.trunc(F.col(column).cast("date"), unit)


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("t")).agg(F.sum("value").alias("y"), F.count("*").cast("double").alias("x"))


def events_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy(F.col("ts").alias("t")).agg(F.sum("value").alias("y"), F.count("*").cast("double").alias("x"))


def orders_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").groupBy(_trunc("month", "o_orderdate").alias("t")).agg(F.sum("o_totalprice").alias("y"), F.count("*").cast("double").alias("x"))


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("entity"), F.col("ts").cast("date").alias("t")).agg(F.sum("value").alias("y"), F.count("*").cast("double").alias("x"))


def orders_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("entity"), _trunc("quarter", "o_orderdate").alias("t")).agg(F.sum("o_totalprice").alias("y"), F.count("*").cast("double").alias("x"))


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).select(F.col("c_nationkey").alias("entity"), _trunc("month", "o_orderdate").alias("t"), "o_totalprice")
    return rows.groupBy("entity", "t").agg(F.sum("o_totalprice").alias("y"), F.count("*").cast("double").alias("x"))


def lines_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), _trunc("month", "l_shipdate").alias("t")).agg(F.sum("l_extendedprice").alias("y"), F.sum("l_quantity").alias("x"))


_SOURCES_SQL = {
    events_daily: "SELECT 'all' AS e, CAST(ts AS DATE) AS t, sum(value) AS y, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY ALL",
    events_by_time: "SELECT 'all' AS e, ts AS t, sum(value) AS y, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY ALL",
    orders_monthly: "SELECT 'all' AS e, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, sum(o_totalprice) AS y, CAST(count(*) AS DOUBLE) AS x FROM orders GROUP BY ALL",
    events_by_type: "SELECT event_type AS e, CAST(ts AS DATE) AS t, sum(value) AS y, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY ALL",
    orders_by_priority: "SELECT o_orderpriority AS e, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS t, sum(o_totalprice) AS y, CAST(count(*) AS DOUBLE) AS x FROM orders GROUP BY ALL",
    orders_by_nation: "SELECT c_nationkey AS e, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, sum(o_totalprice) AS y, CAST(count(*) AS DOUBLE) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    lines_by_supplier: "SELECT l_suppkey AS e, CAST(date_trunc('month', l_shipdate) AS DATE) AS t, sum(l_extendedprice) AS y, sum(l_quantity) AS x FROM lineitem GROUP BY ALL",
}


@dataclass(frozen=True)
class Case:
    """A splitter over a source, and the pieces of SQL that say the same."""

    source: Callable[[SparkSession, str], DataFrame]
    splitter: type
    options: dict = field(default_factory=dict)
    anchors_sql: str = ""
    test_size_sql: str = "1"
    points: bool = False
    run_on: int | None = None

    @property
    def panel(self) -> bool:
        return "Panel" in self.splitter.__name__ or self.source not in (events_daily, events_by_time, orders_monthly)

    @property
    def columns(self) -> list[str]:
        return ["entity", "t"] if self.panel else ["t"]

    def assign(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.splitter(**self.options).assign(self.source(spark, sf_dir), "t", "entity" if self.panel else None)

    def ctes(self) -> str:
        o = self.options
        k, gap, m = o.get("n_splits", 5), o.get("gap", 0), o.get("max_train_size")
        default = f"SELECT f.i AS fold_id, NULL AS e, tt.t FROM range({k}) f(i) JOIN tt ON tt.i = tt.nt - {k} * ({self.test_size_sql}) + f.i * ({self.test_size_sql})"
        time_order = "min(e), t" if o.get("time_order") == "first_seen" else "t"
        in_sample = self.splitter.mode == "is"
        end = "hi" if in_sample else f"greatest(lo - {gap}, 0)"
        if in_sample:
            start = "0" if m is None else f"greatest(hi - greatest({m}, n_test), 0)"
        else:
            start = f"greatest({end} - {m}, 0)" if m else "0"
        if self.run_on is not None:
            spans = f"SELECT 0 AS fold_id, g.e, min(g.pos) AS lo, max(g.pos) + 1 AS hi, count(*) AS n_test, NULL AS points FROM (SELECT *, row_number() OVER (ORDER BY e, t) - 1 AS g FROM k) g WHERE g.g >= {self.run_on} AND g.g < {self.run_on} + {self.test_size_sql} GROUP BY g.e"
        elif self.points:
            spans = "SELECT 0 AS fold_id, k.e, min(k.pos) AS lo, max(k.pos) + 1 AS hi, count(*) AS n_test, list(k.pos) AS points FROM a JOIN k ON k.t = a.t AND (a.e IS NULL OR a.e = k.e) GROUP BY k.e"
        else:
            spans = f"SELECT a.fold_id, k.e, k.pos AS lo, least(k.pos + ({self.test_size_sql}), k.n) AS hi, least(k.pos + ({self.test_size_sql}), k.n) - k.pos AS n_test, NULL AS points FROM a JOIN k ON k.t = a.t AND (a.e IS NULL OR a.e = k.e) LEFT JOIN tt ON tt.t = a.t"
        return f"""
            src AS ({_SOURCES_SQL[self.source]}),
            k AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY e) AS n FROM src),
            tt AS (SELECT t, row_number() OVER (ORDER BY {time_order}) - 1 AS i, count(*) OVER () AS nt FROM src GROUP BY t),
            a AS ({self.anchors_sql or default}),
            b AS ({spans}),
            w AS (SELECT *, {start} AS train_lo, {end} AS train_hi FROM b),
            assigned AS (
                SELECT CAST(w.fold_id AS INTEGER) AS fold_id, 'test' AS role, k.e AS entity, k.t, CAST(k.pos AS BIGINT) AS pos, k.y, k.x FROM w JOIN k ON k.e = w.e
                WHERE CASE WHEN w.points IS NULL THEN k.pos >= w.lo AND k.pos < w.hi ELSE list_contains(w.points, k.pos) END
                UNION ALL
                SELECT CAST(w.fold_id AS INTEGER), 'train', k.e, k.t, CAST(k.pos AS BIGINT), k.y, k.x FROM w JOIN k ON k.e = w.e AND k.pos >= w.train_lo AND k.pos < w.train_hi)"""

    def sql(self) -> str:
        return f"WITH {self.ctes()} SELECT fold_id, role, {'entity, ' if self.panel else ''}t, pos FROM assigned"


def _dates(*days: str) -> list[dt.date]:
    return [dt.date.fromisoformat(d) for d in days]


def _times_sql(*days: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS fold_id, NULL AS e, DATE '{d}' AS t" for i, d in enumerate(days))


def _pairs_sql(*pairs: tuple) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS fold_id, {e!r} AS e, DATE '{d}' AS t" for i, (e, d) in enumerate(pairs))


_PLACES_SQL = "SELECT {fold} AS fold_id, 'all' AS e, t FROM tt WHERE i IN ({places})"
_GLOBAL_SQL = "SELECT {fold} AS fold_id, e, t FROM (SELECT e, t, row_number() OVER (ORDER BY e, t) - 1 AS g FROM src) WHERE g IN ({places})"
_PAIRS = ((3, "1996-02-01"), (7, "1997-05-01"), (7, "1999-01-01"))
_OOS, _IS, _POOS, _PIS = cf.TSOutOfSampleSplit, cf.TSInSampleSplit, cf.PanelOutOfSampleSplit, cf.PanelInSampleSplit
_NT = "(SELECT count(*) FROM tt)"
_IS_DEFAULT = "SELECT 0 AS fold_id, NULL AS e, t FROM tt WHERE i = nt - {size}"

CASES: dict[str, Case] = {
    "ts_oos_default": Case(events_daily, _OOS, {"n_splits": 5, "test_size": 3}, test_size_sql="3"),
    "ts_oos_auto_test_size": Case(events_daily, _OOS, {"n_splits": 5}, test_size_sql="tt.nt // 6"),
    "ts_oos_gap": Case(events_daily, _OOS, {"n_splits": 3, "test_size": 4, "gap": 2}, test_size_sql="4"),
    "ts_oos_rolling": Case(events_daily, _OOS, {"n_splits": 3, "test_size": 4, "gap": 1, "max_train_size": 8}, test_size_sql="4"),
    "ts_oos_empty_train": Case(events_daily, _OOS, {"n_splits": 3, "test_size": 5, "gap": 20}, test_size_sql="5"),
    "ts_oos_zero_max_train": Case(events_daily, _OOS, {"n_splits": 2, "test_size": 2, "max_train_size": 0}, test_size_sql="2"),
    "ts_oos_thousand_folds": Case(events_by_time, _OOS, {"n_splits": 999, "gap": 5, "max_train_size": 200}, test_size_sql="tt.nt // 1000"),
    "ts_is_many_positions": Case(events_by_time, _IS, {"test_indices": list(range(3, 900, 9)), "max_train_size": 120}, _PLACES_SQL.format(fold="0", places=", ".join(map(str, range(3, 900, 9)))), points=True),
    "ts_oos_dates": Case(orders_monthly, _OOS, {"test_indices": _dates("1996-03-01", "1998-06-01"), "test_size": 3, "gap": 1}, _times_sql("1996-03-01", "1998-06-01"), "3"),
    "ts_oos_positions": Case(orders_monthly, _OOS, {"test_indices": [70, 10, 40], "test_size": 2}, _PLACES_SQL.format(fold="row_number() OVER (ORDER BY t) - 1", places="10, 40, 70"), "2"),
    "ts_is_default": Case(orders_monthly, _IS, {"test_size": 6}, _IS_DEFAULT.format(size=6), "6"),
    "ts_is_auto_test_size": Case(orders_monthly, _IS, {"n_splits": 3}, _IS_DEFAULT.format(size="nt // 4"), "tt.nt // 4"),
    "ts_is_one_date": Case(orders_monthly, _IS, {"test_indices": "1999-01-01", "test_size": 4}, _times_sql("1999-01-01"), "4"),
    "ts_is_many_dates": Case(orders_monthly, _IS, {"test_indices": _dates("1996-01-01", "1997-07-01", "2000-02-01"), "test_size": 4}, _times_sql("1996-01-01", "1997-07-01", "2000-02-01"), points=True),
    "ts_is_max_train": Case(orders_monthly, _IS, {"test_size": 6, "max_train_size": 24}, _IS_DEFAULT.format(size=6), "6"),
    "ts_is_max_train_below_test": Case(orders_monthly, _IS, {"test_size": 6, "max_train_size": 2}, _IS_DEFAULT.format(size=6), "6"),
    "ts_is_many_small_max": Case(orders_monthly, _IS, {"test_indices": [4, 9, 14], "max_train_size": 5}, _PLACES_SQL.format(fold="0", places="4, 9, 14"), points=True),
    "base_oos_series": Case(orders_monthly, cf.OutOfSampleSplit, {"n_splits": 4, "test_size": 5, "gap": 1, "max_train_size": 30}, test_size_sql="5"),
    "base_oos_panel": Case(orders_by_priority, cf.OutOfSampleSplit, {"n_splits": 3, "test_size": 2, "gap": 1}, test_size_sql="2"),
    "base_is_series": Case(events_daily, cf.InSampleSplit, {"test_size": 7, "max_train_size": 10}, _IS_DEFAULT.format(size=7), "7"),
    "base_is_panel": Case(events_by_type, cf.InSampleSplit, {"test_indices": _dates("2024-01-10", "2024-01-20"), "max_train_size": 4}, _times_sql("2024-01-10", "2024-01-20"), points=True),
    "panel_oos_default": Case(orders_by_priority, _POOS, {"n_splits": 4, "test_size": 2}, test_size_sql="2"),
    "panel_oos_gap": Case(events_by_type, _POOS, {"n_splits": 2, "test_size": 3, "gap": 5}, test_size_sql="3"),
    "panel_oos_rolling": Case(events_by_type, _POOS, {"n_splits": 3, "test_size": 5, "gap": 2, "max_train_size": 10}, test_size_sql="5"),
    "panel_oos_dates": Case(orders_by_priority, _POOS, {"test_indices": _dates("1996-04-01", "1999-10-01"), "test_size": 2}, _times_sql("1996-04-01", "1999-10-01"), "2"),
    "panel_oos_dates_unsorted_order": Case(orders_by_priority, _POOS, {"test_indices": _dates("1999-10-01", "1996-04-01"), "test_size": 2}, _times_sql("1999-10-01", "1996-04-01"), "2"),
    "panel_oos_skip_missing": Case(orders_by_nation, _POOS, {"n_splits": 4, "test_size": 3, "missing": "skip"}, test_size_sql="3"),
    "panel_oos_first_seen": Case(lines_by_supplier, _POOS, {"n_splits": 4, "test_size": 3, "missing": "skip", "time_order": "first_seen"}, test_size_sql="3"),
    "panel_oos_many_entities": Case(lines_by_supplier, _POOS, {"n_splits": 3, "test_size": 2, "gap": 1, "max_train_size": 12, "missing": "skip"}, test_size_sql="2"),
    "panel_oos_many_folds": Case(lines_by_supplier, _POOS, {"n_splits": 60, "test_size": 1, "gap": 1, "max_train_size": 6, "missing": "skip"}, test_size_sql="1"),
    "panel_oos_tuples_skip": Case(orders_by_nation, _POOS, {"test_indices": [(e, dt.date.fromisoformat(d)) for e, d in _PAIRS], "test_size": 2, "missing": "skip"}, _pairs_sql(*_PAIRS), "2"),
    "panel_is_default": Case(events_by_type, _PIS, {"test_size": 5}, _IS_DEFAULT.format(size=1), "5"),
    "panel_is_one_date": Case(events_by_type, _PIS, {"test_indices": "2024-01-15", "test_size": 3}, _times_sql("2024-01-15"), "3"),
    "panel_is_many_dates": Case(events_by_type, _PIS, {"test_indices": _dates("2024-01-10", "2024-01-20"), "test_size": 3}, _times_sql("2024-01-10", "2024-01-20"), points=True),
    "panel_is_max_train": Case(orders_by_priority, _PIS, {"test_indices": _dates("1998-01-01"), "test_size": 4, "max_train_size": 6}, _times_sql("1998-01-01"), "4"),
    "panel_is_positions": Case(events_by_type, _PIS, {"test_indices": [5, 20, 40], "missing": "skip"}, _GLOBAL_SQL.format(fold="0", places="5, 20, 40"), points=True),
    "panel_is_position_runs_on": Case(events_by_type, _PIS, {"test_indices": [58], "test_size": 4, "missing": "skip"}, _GLOBAL_SQL.format(fold="0", places="58"), "4", run_on=58),
    "panel_is_one_position": Case(events_by_type, _PIS, {"test_indices": [40], "test_size": 4, "missing": "skip"}, _GLOBAL_SQL.format(fold="0", places="40"), "4"),
}
PER_ENTITY = {
    "per_entity_oos": Case(orders_by_priority, cf.PanelOutOfSampleSplitPerEntity, {"n_splits": 2, "test_size": 3, "gap": 1}, test_size_sql="3"),
    "per_entity_is": Case(events_by_type, cf.PanelInSampleSplitPerEntity, {"test_indices": _dates("2024-01-12"), "test_size": 4, "max_train_size": 9}, _times_sql("2024-01-12"), "4"),
}
_ML = Case(events_by_type, _POOS, {"n_splits": 3, "test_size": 4}, test_size_sql="4")
_CV = Case(lines_by_supplier, _POOS, {"n_splits": 3, "test_size": 6, "gap": 1, "missing": "skip"}, test_size_sql="6")
_CV_NATIONS = Case(orders_by_nation, _POOS, {"n_splits": 4, "test_size": 3, "gap": 1, "missing": "skip"}, test_size_sql="3")
_CV_SERIES = CASES["ts_oos_rolling"]


def _described(case: Case):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metrics.describe_folds(case.assign(spark, sf_dir), "t", ["entity"] if case.panel else [])

    return run


def _described_sql(case: Case) -> str:
    e = "entity, " if case.panel else ""
    return f"""WITH {case.ctes()} SELECT fold_id, {e}count(*) FILTER (role = 'train') AS train_size, count(*) FILTER (role = 'test') AS test_size,
        min(t) FILTER (role = 'train') AS train_first, max(t) FILTER (role = 'train') AS train_last, min(t) FILTER (role = 'test') AS test_first, max(t) FILTER (role = 'test') AS test_last,
        CAST(date_diff('day', max(t) FILTER (role = 'train'), min(t) FILTER (role = 'test')) AS INTEGER) AS gap_days FROM assigned GROUP BY ALL"""


def fold_time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    case, keys = CASES["panel_oos_rolling"], Keys("t", "entity")
    splitter = case.splitter(**case.options)
    rows = case.source(spark, sf_dir)
    ranks = key_ops.ranked(rows, keys)
    return time_bounds(ranks, fold_bounds(ranks, keys, splitter.spec, key_ops.check_keys(rows, keys))[0], keys)


def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.split_statistics(CASES["panel_oos_skip_missing"].assign(spark, sf_dir), "entity")


def in_sample_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchors that a short train leaves out."""
    return metrics.outside_train(CASES["ts_is_many_small_max"].assign(spark, sf_dir), ["t"])


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overlap(CASES["panel_is_one_date"].assign(spark, sf_dir), ["entity", "t"])


def _ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "event_type", "ts")


def key_sorted_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ordered_events(spark, sf_dir)
    return spark.createDataFrame([(key_ops.sorted_by_time(rows, "event_id", "ts"), key_ops.sorted_within_entities(rows, "event_id", Keys("ts", "event_type")))], "by_time boolean, within_entities boolean")


def entity_grouped_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_ops.entity_runs(_ordered_events(spark, sf_dir), "event_id", "event_type")


def unsorted_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a splitter that is told the order of the rows warns: of the raw order, and of one by event type and time."""
    rows = _ordered_events(spark, sf_dir).groupBy("event_type", "ts").agg(F.min("event_id").alias("event_id"))
    orders = {"as_stored": rows, "by_key": rows.withColumn("event_id", F.struct("event_type", "ts"))}
    found = []
    for name, df in orders.items():
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            key_ops.warn_if_unsorted(df, "event_id", Keys("ts", "event_type"))
        found.append((name, any("not sorted" in str(w.message) for w in seen)))
    return spark.createDataFrame(found, "rows_in string, warned boolean")


#: Anchors of one test each, known or not.
ANCHORS = {
    "last_position": 149, "position_beyond": 150, "negative_position": -1,
    "known_time": "2024-01-10", "unknown_time": "2025-01-01",
    "known_pair": ("click", dt.date(2024, 1, 10)), "unknown_entity": ("nobody", dt.date(2024, 1, 10)), "unknown_time_of_entity": ("click", dt.date(2025, 1, 1)),
}


def anchor_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which anchors are refused."""
    rows, found = events_by_type(spark, sf_dir), []
    for name, anchor in ANCHORS.items():
        try:
            cf.PanelInSampleSplit(test_indices=[anchor], missing="skip").assign(rows, "t", "entity")
            found.append((name, False))
        except ValueError:
            found.append((name, True))
    return spark.createDataFrame(found, "anchor string, refused boolean")


def _refused(build: Callable[[], object]) -> bool:
    try:
        build()
    except ValueError:
        return True
    return False


def split_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests are refused, of the daily events and of the nations' months, whose nations don't all have orders in every month."""
    series, panel = events_daily(spark, sf_dir), orders_by_nation(spark, sf_dir)
    first = "1992-01-01"
    cases = {
        "panel_without_entity": lambda: _POOS(2).assign(panel, "t"),
        "panel_without_its_column": lambda: _POOS(2).assign(panel.drop("entity"), "t", "entity"),
        "series_without_time": lambda: _OOS(test_indices="2024-01-10").assign(series.drop("t"), "t"),
        "one_fold": lambda: _OOS(1),
        "half_folds": lambda: _OOS(2.5),
        "two_folds": lambda: _OOS(2).assign(series, "t"),
        "pair_on_a_series": lambda: _OOS(test_indices=[("click", dt.date(2024, 1, 10))]).assign(series, "t"),
        "label_of_a_series": lambda: _OOS(test_indices="2024-01-10").assign(series, "t"),
        "nation_without_test_rows": lambda: _POOS(test_indices=first, test_size=1).assign(panel, "t", "entity"),
        "nation_skipped": lambda: _POOS(test_indices=first, test_size=1, missing="skip").assign(panel, "t", "entity"),
        "month_of_all_or_none": lambda: _POOS(test_indices="1996-02-01", test_size=1).assign(panel, "t", "entity"),
    }
    return spark.createDataFrame([(name, _refused(build)) for name, build in cases.items()], "request string, refused boolean")


def fold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many folds splitters say that they give, which is how many they give, whatever n_splits says."""
    months, types = orders_monthly(spark, sf_dir), events_by_type(spark, sf_dir)
    asked = {
        "default": (_OOS(4, test_size=3), months, None), "positions": (_OOS(test_indices=[9, 4, 30]), months, None), "in_sample": (_IS(5), months, None),
        "panel": (_POOS(3, test_size=2), types, "entity"), "panel_times": (_POOS(test_indices=_dates("2024-01-10", "2024-01-20")), types, "entity"), "each_entity": (cf.PanelOutOfSampleSplitPerEntity(3, test_size=2), types, "entity"),
    }
    found = []
    for name, (splitter, df, entity) in asked.items():
        source = splitter.source(df, "t", entity)
        keys = ["fold_id", *([entity] if name == "each_entity" else [])]
        found.append((name, splitter.get_n_splits(source), splitter.assign(source, role="test").select(*keys).distinct().count(), splitter.spec.n_splits))
    return spark.createDataFrame(found, "splitter string, said long, given long, n_splits long")


def _anchors_sql() -> str:
    def refused(anchor) -> str:
        if isinstance(anchor, int):
            return f"{anchor} < 0 OR {anchor} >= (SELECT count(*) FROM k)"
        entity, day = anchor if isinstance(anchor, tuple) else (None, anchor)
        return f"NOT EXISTS (SELECT 1 FROM k WHERE t = DATE '{day}'" + (f" AND e = '{entity}')" if entity else ")")

    cases = " UNION ALL ".join(f"SELECT '{name}' AS anchor, {refused(anchor)} AS refused" for name, anchor in ANCHORS.items())
    return f"WITH k AS ({_SOURCES_SQL[events_by_type]}) {cases}"


def stored_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line stands in its file."""
    return key_ops.with_stored_positions(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "position")


def stored_order_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a splitter warns of the order in which files hold their rows, without a column that numbers them."""
    cases = {"events_by_time": ("events", Keys("ts")), "events_by_type": ("events", Keys("ts", "event_type")), "orders_by_time": ("orders", Keys("o_orderdate")), "nations_by_key": ("nation", Keys("n_nationkey"))}
    found = []
    for name, (table, keys) in cases.items():
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            key_ops.warn_if_unsorted(_table(spark, sf_dir, table), key_ops.STORED, keys)
        found.append((name, any("not sorted" in str(w.message) for w in seen)))
    return spark.createDataFrame(found, "rows_of string, warned boolean")


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("entity"), F.date_trunc("hour", "ts").alias("t"), F.col("event_id").alias("id"))


def repeated_times_oos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the hour, so times repeat: rows of an hour stand in the order of their ids."""
    return cf.TSOutOfSampleSplit(4, test_size=50, gap=3, max_train_size=120, tiebreak="id").assign(_hourly(spark, sf_dir).drop("entity"), "t")


def repeated_times_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by event type; tests start with the first event of the last hours."""
    return cf.PanelOutOfSampleSplit(3, test_size=8, gap=1, max_train_size=30, missing="skip", tiebreak=["id"]).assign(_hourly(spark, sf_dir), "t", "entity")


def xy_key_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys against those of the raw rows in another order, against fewer, and against some of them twice."""
    x, keys = events_by_type(spark, sf_dir), Keys("t", "entity")
    raw = _ordered_events(spark, sf_dir).select(F.col("event_type").alias("entity"), F.col("ts").cast("date").alias("t"))
    again = raw.distinct().unionByName(raw.where("entity = 'click'").distinct())
    found = [key_ops.same_keys(x, y, keys) for y in (raw.distinct().orderBy(F.desc("t")), raw.where("t <> date'2024-01-07'").distinct(), again)]
    return spark.createDataFrame([found], "same boolean, fewer boolean, twice boolean")


def group_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_ops.ranked(lines_by_supplier(spark, sf_dir), Keys("t", "entity"), spread=True)


def align_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.align_horizon(orders_by_nation(spark, sf_dir), "x", 3, "t", "entity")
    return out.select("entity", "t", "x", "target_ahead")


def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.lag_features(lines_by_supplier(spark, sf_dir).select("entity", "t", "x"), "x", [1, 7, 14], "t", "entity")
    return features.complete_rows(rows)


def publication_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.publication_delay(events_by_type(spark, sf_dir).select("entity", "t", "x"), ["x"], 2, "t", "entity")


def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.trend(features.calendar_features(events_daily(spark, sf_dir).select("t"), "t"), "t")


def cross_section_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.cross_section(lines_by_supplier(spark, sf_dir), "x", "t")
    return out.select("t", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of each nation that have orders, in per cent of the months of all."""
    rows = orders_by_nation(spark, sf_dir)
    ends = rows.agg(F.min("t").alias("first"), F.max("t").alias("last")).first()
    months = F.explode(F.sequence(F.lit(ends["first"]), F.lit(ends["last"]), F.expr("interval 1 month")))
    grid = rows.select("entity").distinct().select("entity", months.alias("t"))
    return grid.join(rows.select("entity", "t", "y"), ["entity", "t"], "left").groupBy("entity").agg(F.round(features.share_known("y"), 6).alias("known"))


def _cv_source(case: Case, spark: SparkSession, sf_dir: str):
    splitter = case.splitter(**case.options)
    return splitter, splitter.source(case.source(spark, sf_dir), "t", "entity" if case.panel else None)


def cv_ratio_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.ratio_by_sums(*_cv_source(_CV, spark, sf_dir), "y", "x")
    return rows.groupBy("fold_id").agg(F.round(metrics.rmse("y", "prediction"), 3).alias("rmse"), F.count("*").alias("n"))


def cv_mae_mape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.ratio_by_sums(*_cv_source(_CV, spark, sf_dir), "y", "x")
    return rows.groupBy("fold_id").agg(F.round(metrics.mae("y", "prediction"), 3).alias("mae"), F.round(metrics.mape("y", "prediction"), 5).alias("mape"))


def cv_ratio_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from copies of each fold's train rows, of nations in place of suppliers."""
    splitter, source = _cv_source(_CV_NATIONS, spark, sf_dir)
    rows = splitter.assign_rows(source)
    predicted = models.ratio_model(rows.select("entity", "t", "y", "x").distinct(), rows.select("fold_id", "role", "entity", "t"), ["entity", "t"], "y", "x", ["entity"])
    return predicted.groupBy("fold_id").agg(F.round(metrics.rmse("y", "prediction"), 3).alias("rmse"), F.count("*").alias("n"))


def cv_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.ratio_by_sums(*_cv_source(_CV_SERIES, spark, sf_dir), "y", "x")
    return metrics.direction_accuracy(rows, "y", "prediction", "t", ["fold_id"]).withColumn("direction_accuracy", F.round("direction_accuracy", 6))


def cv_linear_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regression.regression_model(*_cv_source(_CV, spark, sf_dir), "y", ["x"])
    return rows.groupBy("entity").agg(F.round(metrics.mae("y", "prediction"), 2).alias("mae"))


def cv_two_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target on this and the last month's quantity, by fold and supplier."""
    splitter = _CV.splitter(**_CV.options)
    source = splitter.source(features.lag_features(_CV.source(spark, sf_dir), "x", [1], "t", "entity"), "t", "entity")
    rows = regression.regression_model(splitter, source, "y", ["x", "x_lag_1"])
    return rows.groupBy("fold_id").agg(F.round(metrics.rmse("y", "prediction"), 2).alias("rmse"), F.round(metrics.mae("y", "prediction"), 2).alias("mae"), F.count("prediction").alias("n"))


def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.fold_summary(cv_ratio_rmse(spark, sf_dir), "rmse")
    return out.select("folds", *(F.round(c, 2).alias(c) for c in ("mean", "std_pop", "std_samp")))


def per_entity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each entity's train as the forecast of its test, all folds and entities side by side."""
    import pandas as pd

    case = PER_ENTITY["per_entity_oos"]

    def fit(train: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n_train": [len(train)], "n_test": [len(test)], "mae": [round(float((test["x"] - train["x"].mean()).abs().mean()), 6)]})

    return case.splitter(**case.options).each(case.source(spark, sf_dir), "t", "entity", fit, "n_train long, n_test long, mae double")


def split_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of every fold by ``split``, whose filters on time reach the scan of the events. Events of one time stand in the order of their ids."""
    out = None
    for i, pair in enumerate(cf.TSOutOfSampleSplit(3, gap=10, max_train_size=700, tiebreak="event_id").split(_table(spark, sf_dir, "events").select("ts", "event_id", "value"), "ts")):
        for role, rows in zip(("train", "test"), pair, strict=True):
            one = rows.agg(F.lit(i).alias("fold_id"), F.lit(role).alias("role"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last"))
            out = one if out is None else out.unionByName(one)
    return out


def per_entity_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``per_entity_fit``, by batches: the mean of train from sums of batches, the errors of test from each."""
    import pandas as pd

    case = PER_ENTITY["per_entity_oos"]

    def fit(train, test):
        n, total = 0, 0.0
        for frame in train:
            n, total = n + len(frame), total + float(frame["x"].sum())
        seen, errors = 0, 0.0
        for frame in test:
            seen, errors = seen + len(frame), errors + float((frame["x"] - total / n).abs().sum())
        yield pd.DataFrame({"n_train": [n], "n_test": [seen], "mae": [round(errors / seen, 6)]})

    return case.splitter(**case.options).each_streamed(case.source(spark, sf_dir), "t", "entity", fit, "n_train long, n_test long, mae double")


def entity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.entities(lines_by_supplier(spark, sf_dir), "entity")


def entity_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.entity_section(orders_by_priority(spark, sf_dir).select("entity", "t", "x"), "entity", "2-HIGH")


def time_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.time_section(orders_by_nation(spark, sf_dir).select("entity", "t", "x"), "t", "1996-02-01")


def lag_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags of one series, by ranges."""
    return features.lag_features(events_daily(spark, sf_dir).select("t", "x"), "x", [1, 7], "t", spread=True)


def _ml_scores(spark: SparkSession, sf_dir: str, regression) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler

    from chronofold.ml import cross_validate

    steps = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), regression])
    scores = cross_validate(steps, RegressionEvaluator(labelCol="y"), _ML.splitter(**_ML.options), events_by_type(spark, sf_dir), "t", "entity")
    return spark.createDataFrame([(i, round(s, 3)) for i, s in enumerate(scores)], "fold_id int, rmse double")


def ml_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.regression import LinearRegression

    return _ml_scores(spark, sf_dir, LinearRegression(labelCol="y"))


def ml_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of lines with and without an intercept by fold, and which of the two is chosen."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from chronofold.ml import TemporalSearch

    line = LinearRegression(labelCol="y")
    steps = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), line])
    search = TemporalSearch(steps, [{line.fitIntercept: True}, {line.fitIntercept: False}], RegressionEvaluator(labelCol="y"), _ML.splitter(**_ML.options), "t", "entity")
    found = search.fit(events_by_type(spark, sf_dir))
    return found.by_fold(spark).select("map", "fold_id", F.round("metric", 3).alias("rmse"), (F.col("map") == found.best).alias("chosen"))


def ml_cv_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random forest a fold, which SQL doesn't express."""
    from pyspark.ml.regression import RandomForestRegressor

    return _ml_scores(spark, sf_dir, RandomForestRegressor(labelCol="y", numTrees=10, maxDepth=4, seed=42))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: case.assign for name, case in CASES.items()} | {name: _described(case) for name, case in PER_ENTITY.items()}
QUERIES |= {f"{name}_rows": case.assign for name, case in PER_ENTITY.items()}
QUERIES |= {"fold_describe": _described(CASES["ts_oos_gap"])}
QUERIES |= {f.__name__: f for f in (fold_time_bounds, split_stats, in_sample_check, overlap, key_sorted_check, entity_grouped_check, unsorted_warning, stored_positions, stored_order_warning, repeated_times_oos, repeated_times_panel, anchor_errors, split_errors, fold_counts, xy_key_equality, group_positions, align_horizon, lag_features, publication_delay, calendar_features, cross_section_stats, completeness, cv_ratio_rmse, cv_ratio_rows, cv_mae_mape, cv_direction, cv_linear_per_entity, cv_two_regressors, cv_summary, per_entity_fit, per_entity_streamed, split_slices, entity_list, entity_section, time_section, lag_series, ml_cv, ml_search, ml_cv_forest)}

_RATIO = """coefficient AS (SELECT fold_id, entity, avg(y / nullif(x, 0)) AS c FROM assigned WHERE role = 'train' GROUP BY ALL),
    predicted AS (SELECT a.*, a.x * c AS p FROM assigned a JOIN coefficient USING (fold_id, entity) WHERE role = 'test')"""

ORACLE_SQL: dict[str, str] = {name: case.sql() for name, case in CASES.items()} | {name: _described_sql(case) for name, case in PER_ENTITY.items()}
ORACLE_SQL |= {f"{name}_rows": case.sql() for name, case in PER_ENTITY.items()}
ORACLE_SQL |= {
    "fold_describe": _described_sql(CASES["ts_oos_gap"]),
    "fold_time_bounds": f"WITH {CASES['panel_oos_rolling'].ctes()} SELECT fold_id, entity, role, min(t) AS first, max(t) AS last FROM assigned GROUP BY ALL",
    "split_stats": f"""WITH {CASES["panel_oos_skip_missing"].ctes()}, s AS (SELECT fold_id, count(*) FILTER (role = 'train') AS a, count(*) FILTER (role = 'test') AS b FROM assigned GROUP BY fold_id)
        SELECT count(*) AS folds, avg(a) AS mean_train_size, avg(b) AS mean_test_size, (SELECT count(DISTINCT entity) FROM assigned) AS entities FROM s""",
    "in_sample_check": f"WITH {CASES['ts_is_many_small_max'].ctes()} SELECT fold_id, t FROM assigned x WHERE role = 'test' AND NOT EXISTS (SELECT 1 FROM assigned z WHERE z.role = 'train' AND z.t = x.t AND z.fold_id = x.fold_id)",
    "overlap": f"WITH {CASES['panel_is_one_date'].ctes()} SELECT fold_id, entity, t FROM assigned GROUP BY ALL HAVING count(DISTINCT role) = 2",
    "key_sorted_check": """SELECT NOT EXISTS (SELECT 1 FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS b FROM events) WHERE b > ts) AS by_time,
        NOT EXISTS (SELECT 1 FROM (SELECT ts, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM events) WHERE b > ts) AS within_entities""",
    "entity_grouped_check": """WITH r AS (SELECT event_type, row_number() OVER (ORDER BY event_id) AS p, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS q FROM events)
        SELECT event_type, count(*) AS n, count(DISTINCT p - q) = 1 AS together FROM r GROUP BY event_type""",
    "unsorted_warning": """WITH r AS (SELECT event_type, ts, min(event_id) AS i FROM events GROUP BY ALL),
        p AS (SELECT *, row_number() OVER (ORDER BY i) - row_number() OVER (PARTITION BY event_type ORDER BY i) AS run, lag(ts) OVER (PARTITION BY event_type ORDER BY i) AS before FROM r)
        SELECT 'as_stored' AS rows_in, count(DISTINCT (event_type, run)) > count(DISTINCT event_type) OR bool_or(coalesce(before > ts, false)) AS warned FROM p UNION ALL SELECT 'by_key', false""",
    "stored_positions": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER () - 1 AS position FROM lineitem",
    "stored_order_warning": """WITH e AS (SELECT event_type AS e, ts, row_number() OVER () AS i FROM events), o AS (SELECT o_orderdate AS t, row_number() OVER () AS i FROM orders), n AS (SELECT n_nationkey AS t, row_number() OVER () AS i FROM nation)
        SELECT 'events_by_time' AS rows_of, bool_or(coalesce(b > ts, false)) AS warned FROM (SELECT ts, lag(ts) OVER (ORDER BY i) AS b FROM e) UNION ALL
        SELECT 'events_by_type', count(*) FILTER (new) > count(DISTINCT e) OR bool_or(coalesce(b > ts, false)) FROM (SELECT e, ts, e IS DISTINCT FROM lag(e) OVER (ORDER BY i) AS new, lag(ts) OVER (PARTITION BY e ORDER BY i) AS b FROM e) UNION ALL
        SELECT 'orders_by_time', bool_or(coalesce(b > t, false)) FROM (SELECT t, lag(t) OVER (ORDER BY i) AS b FROM o) UNION ALL
        SELECT 'nations_by_key', bool_or(coalesce(b > t, false)) FROM (SELECT t, lag(t) OVER (ORDER BY i) AS b FROM n)""",
    "repeated_times_oos": """WITH k AS (SELECT date_trunc('hour', ts) AS t, event_id AS id, row_number() OVER (ORDER BY date_trunc('hour', ts), event_id) - 1 AS pos, count(*) OVER () AS n FROM events),
        b AS (SELECT i, n - (4 - i) * 50 AS lo FROM (SELECT DISTINCT n FROM k), range(4) r(i))
        SELECT CAST(i AS INTEGER) AS fold_id, CASE WHEN pos >= lo THEN 'test' ELSE 'train' END AS role, t, id, pos FROM k, b WHERE pos >= lo AND pos < lo + 50 OR pos < lo - 3 AND pos >= greatest(lo - 3, 0) - 120""",
    "repeated_times_panel": """WITH k AS (SELECT event_type AS e, date_trunc('hour', ts) AS t, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts), event_id) - 1 AS pos FROM events),
        h AS (SELECT t, row_number() OVER (ORDER BY t DESC) AS back FROM (SELECT DISTINCT t FROM k)),
        b AS (SELECT e, 3 - back // 8 AS i, min(pos) AS lo FROM k JOIN h USING (t) WHERE back IN (8, 16, 24) GROUP BY ALL)
        SELECT CAST(i AS INTEGER) AS fold_id, CASE WHEN pos >= lo THEN 'test' ELSE 'train' END AS role, e AS entity, t, id, pos FROM k JOIN b USING (e) WHERE pos >= lo AND pos < lo + 8 OR pos < lo - 1 AND pos >= greatest(lo - 1, 0) - 30""",
    "anchor_errors": _anchors_sql(),
    "split_errors": f"""WITH s AS ({_SOURCES_SQL[events_daily]}), p AS ({_SOURCES_SQL[orders_by_nation]}), n AS (SELECT count(DISTINCT e) AS n FROM p),
        m AS (SELECT n > (SELECT count(DISTINCT e) FROM p WHERE t = DATE '1992-01-01') AS early, n > (SELECT count(DISTINCT e) FROM p WHERE t = DATE '1996-02-01') AS late FROM n)
        SELECT unnest(['panel_without_entity', 'panel_without_its_column', 'series_without_time', 'one_fold', 'half_folds', 'pair_on_a_series']) AS request, true AS refused
        UNION ALL SELECT 'two_folds', count(DISTINCT t) < 3 FROM s UNION ALL SELECT 'label_of_a_series', NOT bool_or(t = DATE '2024-01-10') FROM s
        UNION ALL SELECT 'nation_without_test_rows', early FROM m UNION ALL SELECT 'nation_skipped', NOT bool_or(t = DATE '1992-01-01') FROM p UNION ALL SELECT 'month_of_all_or_none', late FROM m""",
    "fold_counts": f"""SELECT splitter, CAST(said AS BIGINT) AS said, CAST(said AS BIGINT) AS given, CAST(n_splits AS BIGINT) AS n_splits
        FROM (VALUES ('default', 4, 4), ('positions', 3, 5), ('in_sample', 1, 5), ('panel', 3, 3), ('panel_times', 2, 5)) x(splitter, said, n_splits)
        UNION ALL SELECT 'each_entity', 3 * count(DISTINCT e), 3 * count(DISTINCT e), 3 FROM ({_SOURCES_SQL[events_by_type]})""",
    "xy_key_equality": """WITH raw AS (SELECT event_type AS e, CAST(ts AS DATE) AS t FROM events),
        x AS (SELECT e, t, count(*) AS rows_of_it, 1 AS n FROM raw GROUP BY e, t),
        y AS (SELECT e, t, count(DISTINCT t) AS same, count(DISTINCT t) FILTER (t <> DATE '2024-01-07') AS fewer, count(DISTINCT t) * CASE WHEN e = 'click' THEN 2 ELSE 1 END AS twice FROM raw GROUP BY e, t)
        SELECT bool_and(n = same) AS same, bool_and(n = fewer) AS fewer, bool_and(n = twice) AS twice FROM x FULL JOIN y USING (e, t)""",
    "per_entity_fit": f"""WITH {PER_ENTITY["per_entity_oos"].ctes()}, m AS (SELECT fold_id, entity, avg(x) AS c, count(*) AS n FROM assigned WHERE role = 'train' GROUP BY ALL)
        SELECT a.fold_id, a.entity, any_value(m.n) AS n_train, count(*) AS n_test, round(avg(abs(a.x - m.c)), 6) AS mae FROM assigned a JOIN m USING (fold_id, entity) WHERE a.role = 'test' GROUP BY ALL""",
    "per_entity_streamed": f"""WITH {PER_ENTITY["per_entity_oos"].ctes()}, m AS (SELECT fold_id, entity, avg(x) AS c, count(*) AS n FROM assigned WHERE role = 'train' GROUP BY ALL)
        SELECT a.fold_id, a.entity, any_value(m.n) AS n_train, count(*) AS n_test, round(avg(abs(a.x - m.c)), 6) AS mae FROM assigned a JOIN m USING (fold_id, entity) WHERE a.role = 'test' GROUP BY ALL""",
    "split_slices": """WITH k AS (SELECT ts, value, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM events),
        b AS (SELECT i, n - (3 - i) * (n // 4) AS lo, n // 4 AS size FROM (SELECT DISTINCT n FROM k), range(3) r(i))
        SELECT CAST(i AS INTEGER) AS fold_id, role, count(*) AS n, round(sum(value), 4) AS total, min(ts) AS first, max(ts) AS last
        FROM (SELECT i, 'test' AS role, k.* FROM k, b WHERE pos >= lo AND pos < lo + size UNION ALL SELECT i, 'train', k.* FROM k, b WHERE pos < lo - 10 AND pos >= lo - 10 - 700) GROUP BY ALL""",
    "entity_list": "SELECT DISTINCT l_suppkey AS entity FROM lineitem",
    "entity_section": f"SELECT t, x FROM ({_SOURCES_SQL[orders_by_priority]}) WHERE e = '2-HIGH'",
    "time_section": f"SELECT e AS entity, x FROM ({_SOURCES_SQL[orders_by_nation]}) WHERE t = DATE '1996-02-01'",
    "lag_series": f"SELECT t, x, lag(x, 1) OVER w AS x_lag_1, lag(x, 7) OVER w AS x_lag_7 FROM ({_SOURCES_SQL[events_daily]}) WINDOW w AS (ORDER BY t)",
    "ml_cv": f"""WITH {_ML.ctes()}, line AS (SELECT fold_id, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM assigned WHERE role = 'train' GROUP BY ALL)
        SELECT fold_id, round(sqrt(avg((y - (i + s * x)) * (y - (i + s * x)))), 3) AS rmse FROM assigned JOIN line USING (fold_id) WHERE role = 'test' GROUP BY fold_id""",
    "ml_search": f"""WITH {_ML.ctes()}, line AS (SELECT fold_id, 0 AS map, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM assigned WHERE role = 'train' GROUP BY ALL UNION ALL SELECT fold_id, 1, sum(x * y) / sum(x * x), 0 FROM assigned WHERE role = 'train' GROUP BY ALL),
        m AS (SELECT map, fold_id, sqrt(avg((y - (i + s * x)) * (y - (i + s * x)))) AS rmse FROM assigned JOIN line USING (fold_id) WHERE role = 'test' GROUP BY ALL),
        best AS (SELECT map AS chosen_map FROM m GROUP BY map ORDER BY avg(rmse), map LIMIT 1)
        SELECT CAST(map AS INTEGER) AS map, fold_id, round(rmse, 3) AS rmse, map = chosen_map AS chosen FROM m, best""",
    "group_positions": f"SELECT e AS entity, t, row_number() OVER (PARTITION BY e ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY e) AS size FROM ({_SOURCES_SQL[lines_by_supplier]})",
    "align_horizon": f"SELECT * FROM (SELECT e AS entity, t, x, lead(x, 3) OVER (PARTITION BY e ORDER BY t) AS target_ahead FROM ({_SOURCES_SQL[orders_by_nation]})) WHERE target_ahead IS NOT NULL",
    "lag_features": f"SELECT * FROM (SELECT e AS entity, t, x, lag(x, 1) OVER w AS x_lag_1, lag(x, 7) OVER w AS x_lag_7, lag(x, 14) OVER w AS x_lag_14 FROM ({_SOURCES_SQL[lines_by_supplier]}) WINDOW w AS (PARTITION BY e ORDER BY t)) WHERE x_lag_14 IS NOT NULL",
    "publication_delay": f"SELECT e AS entity, t, lag(x, 2) OVER (PARTITION BY e ORDER BY t) AS x FROM ({_SOURCES_SQL[events_by_type]})",
    "calendar_features": f"SELECT t, CAST(isodow(t) - 1 AS INTEGER) AS day_of_week, CAST(month(t) AS INTEGER) AS month, CAST(dayofyear(t) AS INTEGER) AS day_of_year, row_number() OVER (ORDER BY t) - 1 AS trend FROM ({_SOURCES_SQL[events_daily]})",
    "cross_section_stats": f"SELECT t, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std FROM ({_SOURCES_SQL[lines_by_supplier]}) GROUP BY t",
    "completeness": f"WITH s AS ({_SOURCES_SQL[orders_by_nation]}) SELECT e AS entity, round(100.0 * count(*) / (SELECT count(DISTINCT t) FROM s), 6) AS known FROM s GROUP BY e",
    "cv_ratio_rmse": f"WITH {_CV.ctes()}, {_RATIO} SELECT fold_id, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, count(*) AS n FROM predicted GROUP BY fold_id",
    "cv_ratio_rows": f"WITH {_CV_NATIONS.ctes()}, {_RATIO} SELECT fold_id, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, count(*) AS n FROM predicted GROUP BY fold_id",
    "cv_two_regressors": f"""WITH {_CV.ctes()}, z AS (SELECT e AS entity, t, lag(x) OVER (PARTITION BY e ORDER BY t) AS z FROM src), r AS (SELECT * FROM assigned JOIN z USING (entity, t)),
        moments AS (SELECT fold_id, entity, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM r WHERE role = 'train' AND z IS NOT NULL GROUP BY ALL),
        slopes AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz FROM moments),
        fitted AS (SELECT fold_id, y, my + bx * (x - mx) + bz * (z - mz) AS p FROM r JOIN slopes USING (fold_id, entity) WHERE role = 'test')
        SELECT fold_id, round(sqrt(avg((y - p) * (y - p))), 2) AS rmse, round(avg(abs(y - p)), 2) AS mae, count(p) AS n FROM fitted GROUP BY fold_id""",
    "cv_mae_mape": f"WITH {_CV.ctes()}, {_RATIO} SELECT fold_id, round(avg(abs(y - p)), 3) AS mae, round(100 * avg(abs((y - p) / nullif(y, 0))), 5) AS mape FROM predicted GROUP BY fold_id",
    "cv_direction": f"""WITH {_CV_SERIES.ctes()}, {_RATIO}, d AS (SELECT fold_id, y - lag(y) OVER w AS dy, p - lag(p) OVER w AS dp FROM predicted WINDOW w AS (PARTITION BY fold_id ORDER BY t))
        SELECT fold_id, round(avg(CASE WHEN sign(dy) = sign(dp) THEN 1.0 ELSE 0.0 END), 6) AS direction_accuracy FROM d GROUP BY fold_id""",
    "cv_linear_per_entity": f"""WITH {_CV.ctes()}, line AS (SELECT fold_id, entity, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM assigned WHERE role = 'train' GROUP BY ALL)
        SELECT entity, round(avg(abs(y - (i + s * x))), 2) AS mae FROM assigned JOIN line USING (fold_id, entity) WHERE role = 'test' GROUP BY entity""",
    "cv_summary": f"""WITH {_CV.ctes()}, {_RATIO}, f AS (SELECT fold_id, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse FROM predicted GROUP BY fold_id)
        SELECT count(rmse) AS folds, round(avg(rmse), 2) AS mean, round(stddev_pop(rmse), 2) AS std_pop, round(stddev_samp(rmse), 2) AS std_samp FROM f""",
}
