"""Hand-written cases at the edges of bins, as-of joins, flags, risk sets."""

import math

import pytest
from pyspark.sql import functions as F

from driftline.functions import trajectory as tr
from driftline.operators import asof, binning, design, evaluate, riskset, sequences, trailing
from driftline.sources import tables


def dynamic(spark, rows):
    return spark.createDataFrame(rows, tables.DYNAMIC)


def static(spark, *rows):
    return spark.createDataFrame([(p, 60, 1, 2, t) for p, t in rows], tables.STATIC)


@pytest.mark.parametrize(("rule", "expect"), [("zero", [0.0, 0.0, 7.0]), ("first", [7.0, 7.0, 7.0]), ("null", [None, None, 7.0])])
def test_asof_before_history(spark, rule, expect):
    asked = spark.createDataFrame([("a", float(i), i) for i in range(3)], "pid string, time double, bin_idx int")
    events = spark.createDataFrame([("a", 1.2, 7.0)], "pid string, time double, value double")
    found = asof.asof(asked, events, ["pid"], ["value"], rule).orderBy("time").collect()
    assert [r["value"] for r in found] == expect


def test_asof_tie_is_inclusive_and_keeps_row_nulls(spark):
    asked = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "pid string, time double")
    events = spark.createDataFrame([("a", 1.0, 5.0, 1.0), ("a", 2.0, None, 2.0)], "pid string, time double, x double, y double")
    found = {r["time"]: (r["x"], r["y"]) for r in asof.asof(asked, events, ["pid"], ["x", "y"], "zero").collect()}
    assert found == {1.0: (5.0, 1.0), 3.0: (None, 2.0)}


def test_asof_unknown_rule(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0)], "pid string, time double, value double")
    with pytest.raises(ValueError):
        asof.asof(rows.drop("value"), rows, ["pid"], ["value"], "next")


def test_bins_are_half_open_and_last_bin_is_whole(spark):
    d = dynamic(spark, [("a", 1.0, "x", 5.0, 0), ("a", 2.9, "x", 7.0, 0), ("a", 3.1, "x", 100.0, 0)])
    grid = binning.bin_grid(static(spark, ("a", 2.3), ("nobody", 5.0)), d)
    assert [(r["bin_idx"], r["start"], r["stop"]) for r in grid.orderBy("bin_idx").collect()] == [(0, 0.0, 1.0), (1, 1.0, 2.0), (2, 2.0, 3.0)]
    assert {(r["bin_idx"], r["value"]) for r in binning.binned_mean(d, grid).collect()} == {(1, 5.0), (2, 7.0)}


@pytest.mark.parametrize(("start", "y", "risk"), [(None, [0, 0, 0, 0], [1, 1, 1, 1]), (2.0, [0, 0, 1, 0], [1, 1, 1, 0]), (0.5, [0, 1, 0, 0], [1, 1, 0, 0])])
def test_event_targets(spark, start, y, risk):
    d = dynamic(spark, [("a", 0.1, "x", 1.5, 0)] + ([("a", start, "x", 2.5, 1)] if start is not None else []))
    grid = binning.bin_grid(static(spark, ("a", 4.0)), d).join(binning.treatment_start(d), "pid")
    rows = binning.event_targets(grid.withColumn("treatment", binning.treated_at(F.col("start"), F.col("t_start")))).orderBy("bin_idx").collect()
    assert [int(r["y_event"]) for r in rows] == y and [int(r["at_risk"]) for r in rows] == risk


def test_event_bin_may_be_left_out(spark):
    rows = spark.createDataFrame([("a", i, int(i >= 2)) for i in range(4)], "pid string, bin_idx int, treatment int")
    assert [r["at_risk"] for r in binning.event_targets(rows, include_event_bin=False).orderBy("bin_idx").collect()] == [1.0, 1.0, 0.0, 0.0]


def test_fill_carries_first_then_takes_the_median(spark):
    d = dynamic(spark, [("a", 0.5, "SBP", 10.0, 0), ("a", 2.5, "SBP", 20.0, 0), ("b", 0.1, "HR", 1.5, 0)])
    rows = binning.aggregate_to_bins(d, static(spark, ("a", 3.0), ("b", 1.0)), ["SBP", "MedA", "none"]).orderBy("pid", "bin_idx").collect()
    assert [r["SBP"] for r in rows] == [10.0, 10.0, 20.0, 10.0]
    assert [r["MedA"] for r in rows] == [0.0] * 4
    assert [r["none"] for r in rows] == [None] * 4
    assert [r["none"] for r in design.fill_zero(binning.aggregate_to_bins(d, static(spark, ("a", 1.0)), ["none"])).collect()] == [0.0]


def test_binary_by_values_is_a_patients_own_matter(spark):
    d = dynamic(spark, [("a", 0.5, "x", 1.0, 0), ("a", 1.5, "x", 0.0, 0), ("b", 0.2, "x", 0.0, 0), ("b", 0.8, "x", 3.0, 0)])
    assert {(r["pid"], r["is_binary"]) for r in binning.binary_features(d).collect()} == {("a", True), ("b", False)}
    rows = binning.aggregate_to_bins(d, static(spark, ("a", 2.0), ("b", 1.0)), ["x"]).orderBy("pid", "bin_idx").collect()
    assert [r["x"] for r in rows] == [1.0, 1.0, 1.5]


def test_flags_of_one_slope_and_of_no_time(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0, 0.0], [0.0, 0.0, 1.0])], "traj array<double>, grid array<double>")
    flags = tr.decline_flags(F.col("traj"), F.col("grid"))
    found = rows.select(tr.slopes(F.col("traj"), F.col("grid")).alias("s"), *[f.alias(n) for n, f in flags.items()]).collect()
    assert [r["s"] for r in found] == [[-1.0], [None, 0.0]]
    assert not any(r["nonlinear"] for r in found)


def test_constant_window_has_unit_deviation(spark):
    rows = spark.createDataFrame([("a", float(i), 3.0) for i in range(4)], "pid string, time double, value double")
    assert {r["sd"] for r in trailing.trailing_statistics(rows, ["pid"], 2.0).collect()} == {1.0}


def test_equal_time_peers_share_a_window(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 3.0), ("a", 9.0, 5.0)], "pid string, time double, value double")
    found = trailing.trailing_rows(rows, ["pid"], 2.0).orderBy("time").collect()
    assert [(r["time"], r["n"]) for r in found] == [(1.0, 2), (9.0, 1)]


def test_softmax_edges(spark):
    rows = spark.createDataFrame([(0, 800.0, 1.0), (0, 0.0, 1.0), (1, 5.0, 0.0), (2, 1.0, 1.0), (2, 1.0, 1.0), (2, 9.0, 0.0)], "bin_idx int, eta double, at_risk double")
    found = sorted((r["bin_idx"], r["eta"], r["ps"]) for r in riskset.riskset_softmax(rows).collect())
    assert found == [(0, 0.0, 0.0), (0, 800.0, 1.0), (1, 5.0, 0.0), (2, 1.0, 0.5), (2, 1.0, 0.5), (2, 9.0, 0.0)]


def test_embedding_export(spark):
    rows = spark.createDataFrame([("p", [[0.0] * 4] * 3), ("q", [[1.0] * 4] * 2)], "pid string, H array<array<double>>")
    made = sequences.embedding_rows(rows, "H", 4)
    assert made.columns == ["pid", "t_idx", "h1", "h2", "h3", "h4"] and made.count() == 5


def test_padding(spark):
    rows = spark.createDataFrame([("p", [1.0], [[1.0, 2.0]], [0]), ("q", [1.0, 2.0], [[3.0, 4.0], [5.0, 6.0]], [-1, 0])], "pid string, a array<double>, b array<array<double>>, i array<int>")
    made = {r["pid"]: r for r in sequences.pad_batches(rows, 10, {"a": "flat", "b": "nested", "i": "index"}).collect()}
    assert made["p"]["a"] == [1.0, 0.0] and made["p"]["b"] == [[1.0, 2.0], [0.0, 0.0]] and made["p"]["i"] == [0, -1]


def test_sequences_without_embedded_rows(spark):
    d = dynamic(spark, [("a", 0.5, "x", 1.5, 0)])
    row = sequences.sequence_samples(d, static(spark, ("a", 2.0)), ["view"], ["x"]).first()
    assert row["raw_time"] == [] and row["idx_map"] == [-1, -1] and row["STD_agg"] == [[1.5], [1.5]]


def test_concordance_against_all_pairs(spark):
    rows = [(float(i % 4), (i * 7 % 5) / 5, i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame([(t, s, int(e)) for t, s, e in rows], "stop double, ps double, treatment int")
    pairs = [(a, b) for a in rows for b in rows if a[2] and (b[0] > a[0] or (b[0] == a[0] and not b[2]))]
    up, tie = sum(b[1] > a[1] for a, b in pairs), sum(b[1] == a[1] for a, b in pairs)
    r = evaluate.concordance(df).first()
    assert (r["concordant"], r["tied"], r["comparable"]) == (up, tie, len(pairs))
    q = evaluate.concordance(df, orientation="risk").first()
    assert math.isclose(r["c_index"] + q["c_index"], 1.0)


def test_csv_and_nan(spark, tmp_path):
    (tmp_path / "s.csv").write_text("PTID,YEARS,MMSE,more\na,1.5,30,x\nb,2,,y\nc,NaN,bad,z\n")
    rows = tables.read_scores_csv(spark, str(tmp_path / "s.csv"), "PTID", "YEARS", "MMSE").orderBy("patient_id").collect()
    assert [tuple(r) for r in rows] == [("a", 1.5, 30.0), ("b", 2.0, None), ("c", None, None)]


def test_intervals_at_risk(spark):
    own = spark.createDataFrame([("a", 0.0, 2.5), ("b", 1.0, 4.0), ("c", 2.0, 2.0)], "pid string, start double, stop double")
    times = spark.createDataFrame([(1.0,), (2.5,), (4.0,)], "event_time double")
    found = sorted((r["event_time"], r["pid"]) for r in design.at_risk_intervals(own, times).collect())
    assert found == [(1.0, "a"), (2.5, "a"), (2.5, "b"), (4.0, "b")]


def test_results_do_not_depend_on_partitions(spark):
    d = tables.event_dynamic(spark, "/root/testdata/sf0.001").where("feature_name in ('view', 'click')")
    key = ["pid", "feature_name"]
    one = trailing.trailing_statistics(d.coalesce(1), key, 14.0, 3).select(*key, "time", "n").collect()
    many = trailing.trailing_statistics(d.repartition(7), key, 14.0, 3).select(*key, "time", "n").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
