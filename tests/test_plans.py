"""Physical-plan checks: the plans we rely on for scale stay the plans we get."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tickflow.operators import events as evo
from tickflow.operators import indicators as ind
from tickflow.sources import fixtures as fx
from tickflow.sources import history as hist
from tickflow.sources.tables import Tables


def plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def exchanges(text):
    return re.findall(r"Arguments: hashpartitioning\(([^)]*)\)", text)


def test_current_data_one_exchange_per_key(spark, sf_dir, capsys):
    p = plan(entry.queries()["current_data"](spark, sf_dir), capsys)
    keys = [k.rsplit(",", 1)[0] for k in exchanges(p)]
    # (symbol, day) for the bars, symbol for all windows, symbol for the quote top-2
    assert len(keys) == 3, keys
    assert "WindowGroupLimit" in p and "Partial" in p
    # every rolling frame in one Window node over one sort
    assert p.count("Window (") <= 3
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate" in p


def test_tail_is_window_group_limit(spark, sf_dir, capsys):
    p = plan(ind.tail_n(fx.daily_bars(Tables(spark, sf_dir).orders), 100), capsys)
    assert re.search(r"WindowGroupLimit.*\n.*\n.*row_number\(\), 100, Partial", p) or \
        ("row_number(), 100, Partial" in p)


def test_fixed_asof_filter_reaches_scan(spark, sf_dir, capsys):
    b = fx.daily_bars(Tables(spark, sf_dir).orders)
    p = plan(hist.last_n_days(b, 30, asof="2001-01-01 00:00:00"), capsys)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", p), p


def test_folds_aggregate_partially_before_shuffle(spark, sf_dir, capsys):
    p = plan(evo.aggregate_state(fx.event_log(Tables(spark, sf_dir).events)), capsys)
    details = p[p.index("(1) Scan"):]
    assert details.index("partial_max_by") < details.index(") Exchange")


def test_routing_never_shuffles_the_log(spark, sf_dir, capsys):
    log = fx.event_log(Tables(spark, sf_dir).events)
    p = plan(evo.route_events(log, evo.routing_table(spark)), capsys)
    assert "BroadcastHashJoin" in p
    assert not exchanges(p)


def test_bars_prune_columns(spark, sf_dir, capsys):
    p = plan(fx.daily_bars(Tables(spark, sf_dir).orders).select("symbol", "close"), capsys)
    m = re.search(r"ReadSchema: struct<([^>]*)>", p)
    assert "o_custkey" not in m.group(1) and "o_orderstatus" not in m.group(1)


def test_forecast_has_no_python_outside_fit(spark, sf_dir, capsys):
    df = entry.queries()["forecast"](spark, sf_dir)
    p = plan(df, capsys)
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    assert "MapInPandas" not in p and "FlatMapGroupsInPandas" not in p


def test_event_history_has_no_whole_key_window(spark, sf_dir, capsys):
    log = fx.event_log(Tables(spark, sf_dir).events)
    p = plan(evo.event_history(log), capsys)
    nodes = re.findall(r"\(\d+\) Window\nInput \[\d+\]: \[([^\]]*)\]\nArguments: \[(.*)", p)
    assert nodes
    for inputs, args in nodes:
        if "event_id" in inputs:   # windows over log rows: partitioned by (aggregate, bucket)
            assert re.search(r"windowspecdefinition\(aggregate_id#\d+, _b#\d+, timestamp", args)
        else:                      # the small (aggregate, bucket) count table
            assert "_n#" in inputs


def test_skewed_aggregate_positions(spark):
    """A key holding most rows gets exact positions through the day buckets."""
    hot = spark.range(20000).select(
        F.when(F.col("id") % 10 < 7, F.lit("HOT")).otherwise(F.concat(F.lit("K"),
                                                                      (F.col("id") % 50).cast("string")))
        .alias("k"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(mins=F.col("id").cast("int")))
        .alias("ts"), F.col("id").alias("seq"))
    from tickflow.functions.ordering import positions
    from pyspark.sql import Window
    got = positions(hot, "k", ["ts", "seq"], "ts", "day")
    ref = hot.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("ts", "seq"))
                         .cast("bigint"))
    assert got.select("seq", "pos").exceptAll(ref.select("seq", "pos")).count() == 0


def test_results_do_not_depend_on_session_time_zone(spark, sf_dir):
    """Wall-clock arithmetic never goes through spark.sql.session.timeZone."""
    names = ["candles_explode", "scalar_format", "min_rows_gate", "event_history",
             "history_from_messages"]
    qs = entry.queries()
    base = {n: sorted(map(tuple, qs[n](spark, sf_dir).collect())) for n in names}
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        for n in names:
            assert sorted(map(tuple, qs[n](spark, sf_dir).collect())) == base[n], n
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_workflow_reads_raw_tables_once(spark, sf_dir, capsys):
    """Bars and coefficients are materialised once; the final plan has no
    Python node, no scan of the events table and one scan of orders (the
    quote top-2, a different input from the bars)."""
    p = plan(entry.queries()["workflow_event_log"](spark, sf_dir), capsys)
    assert "MapInPandas" not in p and "FlatMapGroupsInPandas" not in p
    assert "events.parquet" not in p
    assert len(re.findall(r"Location: InMemoryFileIndex \[[^\]]*orders\.parquet", p)) == 1


def test_appended_log_prunes_date_partitions(spark, sf_dir, capsys):
    """The log is written partitioned by event date; a time-bounded read
    only lists the matching partitions."""
    from tickflow.streaming import live
    path = live.scratch(spark, "pruned-log")
    evo.append_events(fx.event_log(Tables(spark, sf_dir).events), path)
    day = spark.read.parquet(path).filter(F.col("event_date") == F.lit("2024-01-05").cast("date"))
    p = plan(day, capsys)
    assert re.search(r"PartitionFilters: \[[^\]]*event_date", p), p
    assert day.count() == fx.event_log(Tables(spark, sf_dir).events) \
        .filter(F.to_date("timestamp") == F.lit("2024-01-05").cast("date")).count()


def test_status_views_scan_events_twice(spark, sf_dir, capsys):
    """Request list and log: read model, state and processing status share
    one aggregate, so no status view reads the events table a third time."""
    for name in ("status_with_processing", "analysis_status", "workflow_debug_view"):
        p = plan(entry.queries()[name](spark, sf_dir), capsys)
        assert len(re.findall(r"Location: InMemoryFileIndex \[[^\]]*events\.parquet", p)) <= 2, name


def test_fit_groups_only_summed_statistics(spark, sf_dir, capsys):
    """The per-symbol Python group receives summed normal equations (one row
    per matrix entry), never the symbol's training windows."""
    from tickflow.operators import forecast as fc
    coefs = fc.fit_linear(fc.training_set(fx.daily_bars(Tables(spark, sf_dir).orders)))
    p = plan(coefs, capsys)
    assert "MapInPandas" in p and "FlatMapGroupsInPandas" in p
    m = re.search(r"\(\d+\) FlatMapGroupsInPandas\nInput \[\d+\]: \[([^\]]*)\]", p)
    assert m and "lags" not in m.group(1) and "v#" in m.group(1), m
    # the entries are summed with a partial aggregate before the shuffle
    assert "partial_sum(v#" in p
