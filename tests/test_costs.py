"""The cheaper forms give what the plain ones give, and spread their work."""

import numpy as np

from driftline.functions import shapes, splines
from driftline.operators import binning, cox, design, trailing
from driftline.sources import tables


def test_least_slopes_by_exchanges():
    rng = np.random.default_rng(0)
    for n in range(2, 40):
        s = rng.standard_normal((3, n, 50))
        assert np.allclose(shapes.sum_of_least(s, n // 2), np.sort(s, 1)[:, : n // 2].sum(1))


def test_posterior_moments_without_curves():
    rng = np.random.default_rng(1)
    x, y, grid = np.sort(rng.uniform(0, 1, (5, 8)), -1), rng.standard_normal((5, 8)), np.tile(np.linspace(0, 1, 9), (5, 1))
    fit = splines.spline_posteriors(x, y, grid, 6, 500, [np.random.default_rng(i) for i in range(5)])
    mean, sd = fit.moments()
    assert np.allclose(mean, fit.curves.mean(1)) and np.allclose(sd, fit.curves.std(1))


def test_likelihood_as_by_columns(spark):
    rng = np.random.default_rng(2)
    n, columns = 400, [f"x{i}" for i in range(6)]
    rows = [(int(k), int(d), *map(float, x)) for k, d, x in zip(rng.integers(0, 9, n), rng.random(n) < 0.3, rng.standard_normal((n, 6)))]
    design = spark.createDataFrame(rows, "bin_idx int, treatment int, " + ", ".join(f"{c} double" for c in columns)).repartition(3)
    beta, centre, scale = rng.standard_normal(6) * 0.3, rng.standard_normal(6), np.full(6, 1.5)
    for ties in ("efron", "breslow"):
        plain = cox.efron(cox.partial_sums(design, columns, "treatment", "bin_idx", beta, centre, scale), 6, ties)
        made = cox.likelihood(design, columns, "treatment", "bin_idx", beta, centre, scale, ties)
        assert all(np.allclose(a, b) for a, b in zip(plain, made))
    none = cox.likelihood(design.where("bin_idx < 0"), columns, "treatment", "bin_idx", beta, centre, scale, "efron")
    assert none[0] == 0 and not none[1].any() and not none[2].any()


def test_chunks_are_spread_over_tasks(spark):
    rows = spark.range(400).selectExpr("concat('P', id % 100) AS pid", "double(id) AS time", "double(id) AS value")
    made = trailing.series_chunks(rows, ["pid"], 14.0)
    used = made.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(n > 0 for n in used) >= 4


def test_growing_sides_are_not_broadcast(spark):
    """Statistics call a table of a few MB of files small, whatever its rows take in the driver."""
    d = "/root/testdata/sf0.001"
    dynamic, static = tables.event_dynamic(spark, d), tables.event_static(spark, d)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        rows = binning.aggregate_to_bins(dynamic, static, ["purchase", "Med_error"])
        aligned = design.align_rows(binning.bin_grid(static, dynamic), dynamic.where("feature_name = 'view'").withColumnRenamed("pid", "patient_id"), ["value"])
        for made in (dynamic, static, binning.bin_grid(static, dynamic), rows, design.counting_process(static, rows, aligned)):
            made.collect()
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan or made is rows
            assert "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_collinear_columns_end_the_passes(spark):
    """Columns that say the same leave moves of rounding noise, which are no reason for more passes."""
    rng = np.random.default_rng(4)
    n = 20_000
    x, key = rng.standard_normal((n, 3)) * 100, rng.integers(0, 12, n)
    death = (rng.random(n) < 0.2 / (1 + np.exp(-x[:, 0] / 100))).astype(int)
    rows = [(int(k), int(d), *map(float, v), float(v[0] + v[1]), float(v[0] - 3 * v[1]), 7.0) for k, d, v in zip(key, death, x)]
    columns = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame(rows, "bin_idx int, treatment int, " + ", ".join(f"{c} double" for c in columns)).repartition(3)
    plain, fit = cox.fit_cox(df, columns[:3], tolerance=1e-10), cox.fit_cox(df, columns, ridge=1e-9)
    assert fit.steps < 10
    assert np.isclose(fit.log_likelihood, plain.log_likelihood, rtol=0, atol=1e-6)
    assert np.allclose((x - plain.mean) @ plain.beta, (np.array(rows)[:, 2:] - fit.mean) @ fit.beta, atol=1e-6)
