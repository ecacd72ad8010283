"""Fitted models and kernels against independent numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import splines
from driftline.operators import cohort, cox, design, evaluate, ranks, riskset, sequences, summaries, trailing
from driftline.plans import pipelines
from driftline.sources import tables

SF = "/root/testdata/sf0.001"


def partial_likelihood(x, d, k, beta, ties):
    ll = 0.0
    for t in np.unique(k):
        at, dead = k == t, (k == t) & (d > 0)
        w = np.exp(x @ beta)
        ll += (x[dead] @ beta).sum()
        for i in range(dead.sum()):
            ll -= np.log(w[at].sum() - (i / dead.sum() if ties == "efron" else 0) * w[dead].sum())
    return ll


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_maximises_the_partial_likelihood(spark, ties):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    k = rng.integers(0, 5, 300)
    d = (rng.uniform(size=300) < 1 / (1 + np.exp(1 - x[:, 0]))).astype(int)
    df = spark.createDataFrame([(int(b), int(e), float(u), float(v)) for b, e, (u, v) in zip(k, d, x)], "bin_idx int, treatment int, a double, b double")
    fit = cox.fit_cox(df, ["a", "b"], ties=ties, ridge=0.0)
    best = partial_likelihood(x, d, k, fit.beta, ties)
    assert fit.log_likelihood == pytest.approx(partial_likelihood(x - x.mean(0), d, k, fit.beta, ties), abs=1e-6)
    for step in itertools.product((-1e-3, 0, 1e-3), repeat=2):
        assert partial_likelihood(x, d, k, fit.beta + step, ties) <= best + 1e-9


def interval_likelihood(x, start, stop, d, beta, ties):
    ll = 0.0
    w = np.exp(x @ beta)
    for t in np.unique(stop[d > 0]):
        at, dead = (start < t) & (t <= stop), (stop == t) & (d > 0)
        ll += (x[dead] @ beta).sum()
        for i in range(dead.sum()):
            ll -= np.log(w[at].sum() - (i / dead.sum() if ties == "efron" else 0) * w[dead].sum())
    return ll


@pytest.mark.parametrize(("ties", "levels", "digits"), [("efron", 12, 1), ("breslow", 2, 6), ("efron", 3, 6)])
def test_cox_on_general_intervals(spark, ties, levels, digits):
    """Continuous and tied times, overlapping intervals, none, empty and unknown ones; trees of one and of several groups of levels."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    start = np.round(rng.uniform(0, 8, 400), digits)
    stop = np.round(start + rng.exponential(2, 400), digits) + 10.0**-digits
    d = (rng.uniform(size=400) < 0.4 / (1 + np.exp(-x[:, 0]))).astype(int)
    rows = [(float(a), float(b), int(e), float(u), float(v)) for a, b, e, (u, v) in zip(start, stop, d, x)]
    odd = [(3.0, 3.0, 1, 0.1, 0.1), (4.0, 3.0, 1, 0.1, 0.1), (None, 3.0, 1, 0.1, 0.1), (1.0, float("nan"), 0, 0.1, 0.1)]
    df = spark.createDataFrame(rows + odd, "start double, stop double, treatment int, a double, b double")
    fit = cox.fit_cox(df, ["a", "b"], group=None, ties=ties, ridge=0.0, levels=levels)
    best = interval_likelihood(x, start, stop, d, fit.beta, ties)
    assert fit.log_likelihood == pytest.approx(interval_likelihood(x - fit.mean, start, stop, d, fit.beta, ties), abs=1e-8)
    for step in itertools.product((-1e-3, 0, 1e-3), repeat=2):
        assert interval_likelihood(x, start, stop, d, fit.beta + step, ties) <= best + 1e-9


def test_cox_on_bins_as_intervals(spark):
    rng = np.random.default_rng(6)
    x, k = rng.normal(size=(500, 2)), rng.integers(0, 30, 500)
    d = (rng.uniform(size=500) < 0.3).astype(int)
    d[k == 7] = 0
    df = spark.createDataFrame([(int(b), float(b), float(b + 1), int(e), float(u), float(v)) for b, e, (u, v) in zip(k, d, x)], "bin_idx int, start double, stop double, treatment int, a double, b double")
    one, other = cox.fit_cox(df, ["a", "b"], ridge=0.0), cox.fit_cox(df.where("bin_idx <> 7"), ["a", "b"], group=None, ridge=0.0, levels=3)
    assert np.allclose(one.beta, other.beta, atol=1e-8) and np.allclose(one.se, other.se, atol=1e-8)
    none = cox.fit_cox(df.withColumn("treatment", F.lit(0)), ["a", "b"], group=None)
    assert np.allclose(none.beta, 0)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 40, 5000])
@pytest.mark.parametrize("factor", [1.0, 1.0000001, 3.7, 1e6, 1e12])
def test_ties_in_closed_form_are_the_loop(n, factor):
    top = n * factor
    k = np.arange(n)
    logs, first, second = (v[0] for v in cox.falling_sums(np.array([top]), np.array([float(n)])))
    assert logs == pytest.approx(float(np.log(np.longdouble(top) - k).sum()), rel=1e-12, abs=1e-10)
    assert first == pytest.approx(float((1 / (np.longdouble(top) - k)).sum()), rel=1e-12)
    assert second == pytest.approx(float((1 / (np.longdouble(top) - k) ** 2).sum()), rel=1e-12)


def test_risk_set_terms_are_the_loops(spark):
    rng = np.random.default_rng(8)
    for n, dead in ((30, 1), (50, 7), (400, 333)):
        x = rng.normal(size=(n, 2))
        w = np.exp(x @ [0.4, -0.9])
        m = lambda on: [np.array([w[on].sum()]), (w[on, None] * x[on]).sum(0)[None], np.einsum("n,ni,nj->ij", w[on], x[on], x[on])[None]]
        risk, died = m(np.arange(n)), m(np.arange(dead))
        ll, score, info = 0.0, np.zeros(2), np.zeros((2, 2))
        for k in range(dead):
            s0, s1, s2 = (a[0] - k / dead * b[0] for a, b in zip(risk, died))
            ll, score, info = ll + np.log(s0), score + s1 / s0, info + s2 / s0 - np.outer(s1, s1) / s0**2
        made = cox.risk_set_terms(np.array([float(dead)]), risk, died, "efron")
        assert made[0] == pytest.approx(ll, rel=1e-10) and np.allclose(made[1], score, rtol=1e-10, atol=1e-10) and np.allclose(made[2], info, rtol=1e-10, atol=1e-9)


def test_efron_ties_closed_form(spark):
    df = spark.createDataFrame([(0, 1, 0.0), (0, 1, 1.0), (0, 0, 2.0)], "bin_idx int, treatment int, a double")
    b = 0.3
    sums = cox.partial_sums(df, ["a"], "treatment", "bin_idx", np.array([b]), np.zeros(1), np.ones(1))
    ll, score, info = cox.efron(sums, 1)
    w = np.exp(b * np.array([0.0, 1.0, 2.0]))
    assert ll == pytest.approx(b * 1.0 - np.log(w.sum()) - np.log(w.sum() - w[:2].sum() / 2))


def test_model_round_trip(spark, tmp_path):
    model = cox.HazardModel(["a", "b"], np.array([0.5, -1.0]), np.array([1.0, 2.0]), np.array([0.1, 0.2]))
    model.save(spark, str(tmp_path / "m"))
    back = cox.HazardModel.load(spark, str(tmp_path / "m"))
    assert back.columns == model.columns and np.array_equal(back.beta, model.beta) and np.array_equal(back.mean, model.mean)


def test_grouped_logistic(spark):
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=400), rng.integers(0, 2, 400)
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(0.5 + (1 + g) * x)))).astype(float)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(x, g, y)], "x double, g int, y double")
    fits = cox.fit_grouped_logistic(df, ["x"], "y", "g", ridge=0.0)
    for k, fit in fits.items():
        p = 1 / (1 + np.exp(-(fit.beta[0] * x[g == k] + fit.beta[1])))
        assert abs((y[g == k] - p).sum()) < 1e-4 and abs(((y[g == k] - p) * x[g == k]).sum()) < 1e-4


@pytest.mark.parametrize("n", [3, 12_001])
def test_regressions_of_many_times_stay_distributed(spark, n):
    """More times than the driver would hold; a third of all rows at one time. Scores of some times against their own Newton fit."""
    rows = spark.range(6 * n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % n).alias("t"), ((F.col("id") * 37 % 101) / 50.0 - 1).alias("x"), F.when(F.pmod(F.xxhash64("id"), F.lit(5)) < 2, 1.0).otherwise(0.0).alias("y"))
    scored = cox.time_propensity(rows, ["x"], "y", "t")
    assert scored.columns == ["t", "x", "y", "ps"] and scored.count() == 6 * n
    every = np.array(rows.select("x").collect(), float)[:, 0]
    mean, sd = every.mean(), every.std()
    for t in (0, 1, n - 1):
        own = np.array(scored.where(F.col("t") == t).select("x", "y", "ps").collect(), float)
        z = np.column_stack([(own[:, 0] - mean) / sd, np.ones(len(own))])
        beta = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ beta))
            beta += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (own[:, 1] - p) - 1e-3 * beta)
        assert np.allclose(own[:, 2], 1 / (1 + np.exp(-z @ beta)), atol=1e-5)
    if n > cox.MAX_GROUPS:
        with pytest.raises(ValueError):
            cox.fit_grouped_logistic(rows, ["x"], "y", "t")


def test_regressions_by_time_of_empty_tables_and_nulls(spark):
    rows = spark.createDataFrame([(1, 0.5, 1.0), (1, -0.5, 0.0), (None, 0.1, 1.0)], "t int, x double, y double")
    assert cox.time_propensity(rows.limit(0), ["x"], "y", "t").collect() == []
    made = {r["t"] for r in cox.time_propensity(rows, ["x"], "y", "t").collect()}
    assert made == {1}


def test_discrete_hazard_minimises_its_loss(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=200), (rng.uniform(size=200) < 0.3).astype(float)
    df = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(x, y)], "x double, y_event double, at_risk double")
    fit = cox.fit_discrete(df, ["x"])
    loss = lambda b: riskset.hazard_loss(df.withColumn("eta", F.col("x") * float(b[0]) + float(b[1]))).first()["loss"]
    best = loss(fit.beta)
    assert all(loss(fit.beta + np.array(s)) >= best - 1e-9 for s in ((0.05, 0), (-0.05, 0), (0, 0.05), (0, -0.05)))


def test_spline_basis_is_a_partition_of_unity():
    x = np.linspace(0, 1, 50)
    assert np.allclose(splines.bspline_basis(x, splines.even_knots(7, 3), 3).sum(1), 1)
    assert np.allclose(splines.bspline_basis(x, splines.quantile_knots(x, 6, 3), 3).sum(1), 1)


def test_penalised_fit_solves_its_normal_equations():
    rng = np.random.default_rng(3)
    x = np.sort(rng.uniform(size=30))
    y = np.sin(4 * x) + rng.normal(size=30) / 10
    fit = splines.penalised_fit(x, y, 6, 0.3)
    assert np.mean((y - splines.penalised_predict(fit, x)) ** 2) < 0.05
    stiff = splines.penalised_fit(x, y, 6, 1e6)
    assert np.mean((y - splines.penalised_predict(stiff, x)) ** 2) > np.mean((y - splines.penalised_predict(fit, x)) ** 2)
    assert splines.penalised_fit(x, y, 3, 0.3) is None


def test_choices_of_penalised_fits():
    rng = np.random.default_rng(4)
    x = np.linspace(0, 1, 20)
    y = x**2 + rng.normal(size=20) / 20
    best, tried = splines.choose_by_gcv(x, y, 4, 6, [0.3, 1.0], 3)
    assert tried == 6 and best.gcv == min(splines.penalised_fit(x, y, k, lam).gcv for k in (4, 5, 6) for lam in (0.3, 1.0))
    first, tried = splines.choose_first_good(x, y, 4, 6, [0.3, 1.0], 3)
    assert (first.n_splines, first.lam, tried) == (6, 0.3, 1)
    assert splines.choose_by_folds(x, y, 4, 6, [0.3], 3, 4, rng)[0] is not None
    assert splines.candidates(5, 4, 6, 3) == [4]


def test_posterior_moments_against_quadrature():
    rng = np.random.default_rng(5)
    x, y = np.linspace(0, 1, 8), np.array([0.2, -0.4, 0.1, 0.8, 0.3, 1.0, 0.5, 1.2])
    fit = splines.spline_posterior(x, y, x, 5, 20000, rng)
    design = np.column_stack([np.ones(8), splines.bspline_basis(x, splines.quantile_knots(x, 5, 3), 3)])
    grid = np.linspace(0.01, 4, 2000)
    logp, means = [], []
    for s in grid:
        v = s**2 * np.eye(8) + design @ design.T
        logp.append(-(s**2) / 2 - 0.5 * (np.linalg.slogdet(v)[1] + y @ np.linalg.solve(v, y)))
        means.append(design @ design.T @ np.linalg.solve(v, y))
    w = np.exp(np.array(logp) - max(logp))
    w /= w.sum()
    assert fit.sigma.mean() == pytest.approx(w @ grid, abs=0.02)
    assert np.allclose(fit.curves.mean(0), w @ np.array(means), atol=0.03)


def long(spark):
    return pipelines.long_labs(tables.event_dynamic(spark, SF), ["view", "click"])


def test_a_batch_of_posteriors_is_each_alone():
    rng = np.random.default_rng(6)
    x, y = np.sort(rng.uniform(size=(4, 7)), 1), rng.normal(size=(4, 7))
    x[3, 4:] = x[3, 4]  # tied times at the end
    together = splines.spline_posteriors(x, y, x, 6, 50, [np.random.default_rng(i) for i in range(4)])
    for i in range(4):
        alone = splines.spline_posterior(x[i], y[i], x[i], 6, 50, np.random.default_rng(i))
        assert np.allclose(together.curves[i], alone.curves) and np.allclose(together.sigma[i], alone.sigma)


@pytest.mark.parametrize("classifier", list(summaries.SHAPES))
def test_kernels_flags_are_the_columns_flags(spark, classifier):
    rng = np.random.default_rng(7)
    rows = [(f"P{i % 9}", "view", float(t), float(v)) for i in range(9) for t, v in zip(np.sort(rng.integers(0, 40, 30)) / 2, rng.normal(size=30).cumsum())]
    long = spark.createDataFrame(rows, "patient_id string, lab string, time double, lab_value double")
    config = summaries.PosteriorConfig(window=5.0, min_points=5, frequency=2, draws=60)
    one = {tuple(r)[:3]: tuple(r)[3:] for r in summaries.trajectory_probabilities(long, config, classifier).collect()}
    two = {tuple(r)[:3]: tuple(r)[3:] for r in summaries.posterior_frequencies(summaries.posterior_curves(long, config), classifier).collect()}
    assert len(one) > 50 and set(one) == set(two) and all(np.allclose(one[k], two[k]) for k in one)


def test_posterior_draws_do_not_depend_on_partitions(spark):
    config = summaries.PosteriorConfig(window=14.0, min_points=6, frequency=1, draws=20)
    one = summaries.trajectory_probabilities(long(spark).coalesce(1), config).collect()
    two = summaries.trajectory_probabilities(long(spark).repartition(5), config).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and one


def test_gam_covariates_keep_fitted_anchors(spark):
    rows = summaries.gam_covariates(long(spark), ["view", "click"], summaries.GamConfig(window=14.0, min_points=6)).collect()
    assert rows and all(r["view_fit_success"] == 1 or r["click_fit_success"] == 1 for r in rows)


def test_encoder_step_by_step(spark):
    w = sequences.encoder_weights(2, 3, 1)
    x, m, dt = np.array([[1.0, 2.0], [0.5, 0.0]]), np.array([[1.0, 1.0], [1.0, 0.0]]), np.array([[1.0], [0.2]])
    sig = lambda a: 1 / (1 + np.exp(-a))
    h = np.zeros(3)
    for k in range(2):
        d = 1 / (1 + np.exp(dt[k, 0]))
        h = d * h + (1 - d) * np.tanh(w["W_h"] @ (m[k] * x[k]) + w["b_h"])
        inp = np.concatenate([m[k] * x[k], m[k]])
        gi, gh = w["W_ih"] @ inp + w["b_ih"], w["W_hh"] @ h + w["b_hh"]
        r, z = sig(gi[:3] + gh[:3]), sig(gi[3:6] + gh[3:6])
        h = (1 - z) * np.tanh(gi[6:] + r * gh[6:]) + z * h
    assert np.allclose(sequences.encode_sequence(x, m, dt, w)[-1], h)


def test_rhat_and_ess():
    rng = np.random.default_rng(6)
    of = lambda x: evaluate.chain_statistics(np.full(len(x), x.shape[1]), x.mean(1), x.var(1, ddof=1), [evaluate.autocovariance(c) for c in x])
    rhat, ess = of(rng.normal(size=(4, 500)))
    assert abs(rhat - 1) < 0.02 and 1200 < ess < 2600
    apart = rng.normal(size=(4, 500)) + np.arange(4)[:, None] * 3
    assert of(apart)[0] > 2
    slow = np.cumsum(rng.normal(size=(4, 500)), 1)
    assert of(slow)[1] < 100


def test_diagnostics_of_many_parameters_take_no_more_jobs(spark):
    """Medians and ranks of all parameters are found together: the same figures as each alone, in as many jobs."""
    rng = np.random.default_rng(5)
    rows = [(f"p{j}", c, i, float(rng.normal() + j)) for j in range(12) for c in range(2) for i in range(9 + j % 2)]
    df = spark.createDataFrame(rows, "param string, chain int, draw int, value double")
    context = spark.sparkContext

    def jobs(rows, group):
        context.setJobGroup(group, group)
        try:
            return {r["param"]: (r["rhat"], r["ess_bulk"]) for r in evaluate.trace_diagnostics(rows, few=20).collect()}, len(context.statusTracker().getJobIdsForGroup(group))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)

    many, n = jobs(df, "many")
    two, m = jobs(df.where("param in ('p3', 'p4')"), "two")
    assert len(many) == 12 and all(many[p] == pytest.approx(two[p], nan_ok=True) for p in two)
    assert n <= m + 6  # broadcasts may become shuffles


def test_diagnostics_use_all_draws_of_unequal_chains(spark):
    """Against ranks and moments by numpy; the same in one range of values and in many; each draw counts."""
    from statistics import NormalDist

    rng = np.random.default_rng(12)
    rows = [("a", c, i, float(np.round(rng.normal() + 0.3 * c, 1))) for c, n in enumerate((40, 61, 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "param string, chain int, draw int, value double")
    one, many = evaluate.trace_diagnostics(df).first(), evaluate.trace_diagnostics(df, few=5).first()
    assert one["rhat"] == pytest.approx(many["rhat"]) and one["ess_bulk"] == pytest.approx(many["ess_bulk"])
    halves = []
    for c, n in enumerate((40, 61, 25)):
        v = [r[3] for r in rows if r[1] == c]
        halves += [v[: n // 2], v[n - n // 2 :]]

    def scores(parts):
        flat = np.concatenate(parts)
        z = [NormalDist().inv_cdf(((flat < x).sum() + ((flat == x).sum() + 1) / 2 - 0.375) / (len(flat) + 0.25)) for x in flat]
        return np.split(np.array(z), np.cumsum([len(p) for p in parts])[:-1])

    def rhat(parts):
        n = np.mean([len(p) for p in parts])
        within, between = np.mean([np.var(p, ddof=1) for p in parts]), np.var([np.mean(p) for p in parts], ddof=1)
        return np.sqrt(((n - 1) / n * within + between) / within)

    middle = np.median(np.concatenate(halves))
    assert one["rhat"] == pytest.approx(max(rhat(scores(halves)), rhat(scores([np.abs(np.array(p) - middle) for p in halves]))))


@pytest.mark.parametrize("few", [100_000, 20])
def test_orders_over_ranges(spark, few):
    """Concordance at continuous times, risk counts and medians against plain loops, in one range of values and in many."""
    rng = np.random.default_rng(13)
    rows = [(float(rng.uniform(0, 9)) if i % 3 else float(rng.integers(0, 9)), float(np.round(rng.normal(), 1)), int(rng.uniform() < 0.4)) for i in range(150)]
    df = spark.createDataFrame(rows, "stop double, ps double, treatment int")
    found = evaluate.concordance(df, few=few).first()
    pairs = [(a, b) for a in rows for b in rows if a[2] and (b[0] > a[0] or (b[0] == a[0] and not b[2]))]
    assert (found["comparable"], found["concordant"], found["tied"]) == (len(pairs), sum(b[1] > a[1] for a, b in pairs), sum(b[1] == a[1] for a, b in pairs))
    spans = [(float(a), float(a + rng.integers(0, 5))) for a in rng.integers(0, 20, 80)]
    times = sorted({float(x) for x in rng.integers(0, 25, 12)} | {3.5, 7.25})
    counts = design.risk_counts(spark.createDataFrame(spans, "start double, stop double"), spark.createDataFrame([(t,) for t in times], "event_time double"), few=few).collect()
    expect = {t: sum(a < t <= b for a, b in spans) for t in times}
    assert {r["event_time"]: r["n_risk"] for r in counts} == {t: n for t, n in expect.items() if n}
    values = [*rng.lognormal(0, 8, 101).tolist(), None, float("nan"), -1e300, 1e300]
    both = spark.createDataFrame([(v, None if v is None else v * 2, None) for v in values[:-1]], "a double, b double, c double")
    known = [v for v in values[:-1] if v is not None and v == v]
    made = ranks.medians(both, ["a", "b", "c"])
    assert made["a"] == np.median(known) and made["b"] == 2 * np.median(known) and made["c"] is None


def test_mixed_model_recovers_effects(spark):
    rng = np.random.default_rng(7)
    rows = []
    for p in range(60):
        u = rng.normal() * 2
        rows += [(f"p{p}", float(t), float(3 * t - t * t + u + rng.normal() / 2)) for t in rng.uniform(0, 3, 8)]
    df = spark.createDataFrame(rows, "patient_id string, time double, lab_value double")
    _, stats = cohort.mixed_model(df)
    assert stats["beta0"] == pytest.approx(3, abs=0.5) and stats["beta1"] == pytest.approx(-1, abs=0.2)
    assert stats["ratio"] == pytest.approx(16, rel=0.8)


def test_supervised_check_tells_signal(spark):
    rows = [(i, i % 2, float(i % 2) + ((i * 37) % 11) / 20) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id int, label int, x double")
    found = cohort.supervised_check(df, ["x"], "label", "vec_id", folds=3).collect()
    assert len(found) == 3 and min(r["accuracy"] for r in found) > 0.9


def test_facades_round_trip(spark, tmp_path):
    d, s = tables.event_dynamic(spark, SF), tables.event_static(spark, SF)
    model = pipelines.PosteriorPropensity(["view"], ["purchase", "Med_error"], config=summaries.PosteriorConfig(window=14.0, min_points=6, frequency=1, draws=10))
    rows = model.fit(d, s)
    model.save(spark, str(tmp_path / "m"))
    again = pipelines.load(spark, str(tmp_path / "m"))
    both = again.model.score(rows, "twice").select("ps", "twice").collect()
    assert both and all(np.isfinite(r["ps"]) and r["ps"] == pytest.approx(r["twice"]) for r in both)
    assert (again.settings(), again.classifier) == (model.settings(), model.classifier)


@pytest.fixture(scope="module")
def two_halves(spark):
    """Events and patients to learn from, and others to score, whose medians differ."""
    d, s = tables.event_dynamic(spark, SF), tables.event_static(spark, SF)
    first = F.pmod(F.xxhash64("pid"), F.lit(2)) == 0
    raised = F.when(F.col("feature_name") == "purchase", F.col("value") + 500).otherwise(F.col("value"))
    return d, s, d.where(~first).withColumn("value", raised), s.where(~first)


def test_a_loaded_model_scores_new_tables_as_the_fitted_one(spark, two_halves, tmp_path):
    """Nothing is given to ``load``; bins without a value take the medians of the table that was learned from."""
    d, s, other, others = two_halves
    model = pipelines.GamPropensity(["view"], ["purchase"], config=summaries.GamConfig(window=14.0, min_points=6, low=4, high=4, mode="gcv"), static_cols=["age"])
    model.fit(d, s)
    assert set(model.fills) == {"purchase"} and model.fills["purchase"] < 500
    model.save(spark, str(tmp_path / "m"))
    again = pipelines.load(spark, str(tmp_path / "m"))
    assert isinstance(again, pipelines.GamPropensity) and again.settings() == model.settings()
    wanted = {(r["pid"], r["bin_idx"]): r["ps"] for r in model.ps(other, others).collect()}
    got = {(r["pid"], r["bin_idx"]): r["ps"] for r in again.ps(other, others).collect()}
    assert wanted and wanted.keys() == got.keys() and all(got[k] == pytest.approx(v, rel=1e-12) for k, v in wanted.items())
    filled = again.design(other, others).where(F.col("purchase") == model.fills["purchase"]).count()
    assert filled > 0


def test_a_loaded_sequence_model_has_head_and_weights(spark, two_halves, tmp_path):
    d, s, other, others = two_halves
    model = pipelines.SequencePropensity(["view", "click"], ["purchase"], sequences.encoder_weights(2, 2, 3))
    with pytest.raises(ValueError):
        model.save(spark, str(tmp_path / "m"))
    model.fit(d, s, ridge=1.0)
    model.save(spark, str(tmp_path / "m"))
    again = pipelines.load(spark, str(tmp_path / "m"))
    key = lambda r: (r["patient_id"], r["t_idx"])
    wanted, got = ({key(r): r["ps"] for r in m.ps(other, others).collect()} for m in (model, again))
    assert wanted and wanted.keys() == got.keys() and all(got[k] == pytest.approx(v, rel=1e-12) for k, v in wanted.items())


def test_a_classifier_of_ones_own_is_given_to_load(spark, tmp_path):
    own = summaries.CurveClassifier(["up"], lambda curves, grid: {"up": curves[:, -1] > curves[:, 0]})
    model = pipelines.PosteriorPropensity(["view"], ["purchase"], event_mode="onset", classifier=own, model=cox.HazardModel(["purchase"], np.ones(1), np.zeros(1), np.ones(1)))
    model.save(spark, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="classifier"):
        pipelines.load(spark, str(tmp_path / "m"))
    again = pipelines.load(spark, str(tmp_path / "m"), own)
    assert again.classifier is own and again.event_mode == "onset"


def test_posterior_queries_take_the_default_draws(spark):
    from driftline.plans import queries

    assert queries.POSTERIOR.draws == summaries.PosteriorConfig().draws == 4_000
    for made in (queries.m1, queries.m2):
        counts = {r["draws"] for r in made(spark, "/root/testdata/sf0.001").collect()}
        assert counts == {4_000}


@pytest.mark.parametrize(
    ("values", "middle"),
    [([1.0, 2.0, 3.0, np.inf], 2.5), ([np.inf, np.inf, 1.0], np.inf), ([-np.inf, np.inf], np.nan), ([-np.inf, 1.0, 2.0, 5.0, np.inf], 2.0), ([-np.inf, -np.inf, 3.0, np.nan, None], -np.inf), ([np.inf], np.inf), ([1e308, -1e308, 2.0], 2.0)],
)
def test_medians_with_infinite_values(spark, values, middle):
    found = ranks.medians(spark.createDataFrame([(v,) for v in values], "a double"), ["a"])["a"]
    assert found == middle or np.isnan(found) and np.isnan(middle)


@pytest.mark.parametrize("n", [4, 5, 6, 9, 30])
def test_batched_fits_are_the_single_ones(n):
    """Smooth, noisy, constant and repeated points: the same candidate, coefficients and number tried as one window at a time."""
    rng = np.random.default_rng(n)
    x = np.sort(rng.uniform(size=(12, n)), 1)
    x[:, 0], x[:, -1] = 0.0, 1.0
    x[3, 1:-1] = 0.5
    y = np.sin(5 * x) + rng.normal(size=x.shape) * np.linspace(0, 1, 12)[:, None]
    y[4] = 0.0
    lams = [0.3, 1.0, 3.0]
    seeds = lambda: [np.random.default_rng(i) for i in range(12)]
    for many, one in (
        (splines.choose_all_by_gcv(x, y, 4, 6, lams, 3), lambda i: splines.choose_by_gcv(x[i], y[i], 4, 6, lams, 3)),
        (splines.choose_all_first_good(x, y, 4, 6, lams, 3), lambda i: splines.choose_first_good(x[i], y[i], 4, 6, lams, 3)),
        (splines.choose_all_by_folds(x, y, 4, 6, lams, 3, 3, seeds()), lambda i: splines.choose_by_folds(x[i], y[i], 4, 6, lams, 3, 3, seeds()[i])),
    ):
        for i in range(12):
            fit, tried = one(i)
            assert many.tried[i] == tried and (many.n_splines[i] > 0) == (fit is not None)
            if fit is not None and i != 4:
                assert (many.n_splines[i], many.lam[i]) == (fit.n_splines, fit.lam)
                assert np.allclose(many.coefficients[i, : fit.n_splines + 1], fit.coefficients, atol=1e-6)


def test_one_shuffle_finds_all_features(spark):
    """Missing features, null values, ties in time, rows before the first measurement; one exchange whatever the number of features."""
    rows = [("a", 1.0, "f", 3.0), ("a", 1.0, "f", 5.0), ("a", 2.0, "g", None), ("a", 4.0, "f", 1.0), ("b", 3.0, "g", 7.0), ("c", 1.0, "other", 9.0)]
    dynamic = spark.createDataFrame(rows, "pid string, time double, feature_name string, value double")
    asked = spark.createDataFrame([(p, t, int(t)) for p in "abcd" for t in (0.0, 1.0, 2.0, 5.0)], "pid string, time double, bin_idx int")
    for rule in ("zero", "first"):
        made = sequences.feature_values(asked, dynamic, ["f", "g", "h"], "bin_idx", rule)
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        for r in made.collect():
            for j, f in enumerate("fgh"):
                own = sorted((t, v is not None, v) for p, t, n, v in rows if p == r["pid"] and n == f)
                past = [e for e in own if e[0] <= r["time"]]
                hit = past[-1] if past else own[0] if own and rule == "first" else None
                if past == [] and own and rule == "first":
                    hit = min(own)
                assert r[f"x_{j}"] == (hit[2] or 0.0 if hit else 0.0) and r[f"m_{j}"] == float(bool(past))
                assert r[f"dt_{j}"] == (max(1e-6, r["time"] - past[-1][0]) if past else None)


@pytest.mark.parametrize("light", [False, True])
def test_batched_recurrence_is_step_by_step(spark, light):
    """Many patients of unequal length, none too, against one gate at a time; the samples' columns come back unchanged."""
    rng = np.random.default_rng(5)
    w = sequences.encoder_weights(2, 3, 1, light)
    rows = []
    for i, n in enumerate([0, 1, 5, 5, 2, 17]):
        m = rng.integers(0, 2, (n, 2)).astype(float)
        rows.append((f"p{i}", i, rng.normal(size=(n, 2)).tolist(), m.tolist(), rng.uniform(0, 3, (n, 1)).tolist()))
    df = spark.createDataFrame(rows, "pid string, more int, X_raw array<array<double>>, M_raw array<array<double>>, DT_raw array<array<double>>")
    found = {r["pid"]: r for r in sequences.encode(df, w).collect()}
    sig = lambda a: 1 / (1 + np.exp(-a))
    for pid, more, x, m, dt in rows:
        h, want = np.zeros(3), []
        for xk, mk, dk in zip(*(map(np.array, v) for v in (x, m, dt))):
            if light:
                entry = np.concatenate([xk, mk, dk])
            else:
                decay = np.exp(-np.log1p(np.exp(dk.sum())))
                h = decay * h + (1 - decay) * np.tanh(w["W_h"] @ (mk * xk) + w["b_h"])
                entry = np.concatenate([mk * xk, mk])
            a, b = w["W_ih"] @ entry + w["b_ih"], w["W_hh"] @ h + w["b_hh"]
            r, z = sig(a[:3] + b[:3]), sig(a[3:6] + b[3:6])
            h = (1 - z) * np.tanh(a[6:] + r * b[6:]) + z * h
            want.append(h)
        assert found[pid]["more"] == more and found[pid]["X_raw"] == x
        assert np.allclose(np.array(found[pid]["H_raw"]).reshape(-1, 3), np.array(want).reshape(-1, 3))


def test_curve_classifiers_run_in_the_kernel(spark):
    def decline_again(curves, grid, flat=-1.0, decline=-2.0, gap=3.0):
        """The built-in declines, curve by curve."""
        out = {"prolonged_nonprogression": [], "linear_decline": [], "nonlinear": []}
        for s in np.diff(curves, axis=1) / np.diff(grid):
            half = np.sort(s)
            n = len(s) // 2
            out["prolonged_nonprogression"].append((s >= decline).mean() >= 0.8 and s.mean() >= flat)
            out["linear_decline"].append((s < decline).mean() >= 0.8)
            out["nonlinear"].append(bool(n) and abs(half[:n].mean() - half[n:].mean()) > gap)
        return {k: np.array(v) for k, v in out.items()}

    long = pipelines.long_labs(tables.event_dynamic(spark, SF), ["view"])
    config = summaries.PosteriorConfig(window=14.0, min_points=6, df=6, frequency=1, draws=50)
    limits = {"flat": -5.0, "decline": -10.0, "gap": 15.0}
    one = summaries.trajectory_probabilities(long, config, **limits)
    own = summaries.trajectory_probabilities(long, config, summaries.CurveClassifier(["prolonged_nonprogression", "linear_decline", "nonlinear"], decline_again), **limits)
    assert one.columns == own.columns
    key = lambda r: (r["patient_id"], r["lab"], r["time"])
    a, b = ({key(r): tuple(r)[3:] for r in df.collect()} for df in (one, own))
    assert len(a) == own.count() and a.keys() == b.keys()
    assert all(np.allclose(a[k], b[k], atol=0.021) for k in a) and np.mean([np.allclose(a[k], b[k]) for k in a]) > 0.99


def test_windows_slide_over_chunks_as_over_the_table(spark):
    """The same anchors and points as Spark's range frame: ties in time, times at chunk bounds and a whole width apart, negative times, nulls."""
    rng = np.random.default_rng(7)
    rows = [(p, "a" if i % 3 else "b", float(t), float(v)) for p in "xyz" for i, (t, v) in enumerate(zip(np.round(rng.uniform(-20, 60, 150) * 4) / 4, rng.normal(size=150)))]
    rows += [("x", "a", 8.0 * k, 1.0) for k in range(-3, 6)] + [("x", "a", 3.0, None), ("y", "b", 0.1 + 0.2, 2.0), ("y", "b", 2.3, 2.0)]
    df = spark.createDataFrame(rows, "patient_id string, lab string, time double, value double")
    made = {(r["patient_id"], r["lab"], r["time"]): [tuple(w) for w in r["window"]] for r in trailing.trailing_rows(df, ["patient_id", "lab"], 2.0, 3).collect()}
    chunks = trailing.series_chunks(df, ["patient_id", "lab"], 2.0)
    assert chunks.selectExpr("sum(size(t))").first()[0] <= 2 * len(rows)
    slid = chunks.mapInArrow(lambda batches: trailing.sliding_windows(batches, ["patient_id", "lab"], 2.0, 3), "patient_id string, lab string, time double, t array<double>, v array<double>")
    found = {(r["patient_id"], r["lab"], r["time"]): list(zip(r["t"], r["v"])) for r in slid.collect()}
    assert found == made and len(made) > 100
