"""Hazard models fitted by Newton steps whose sums Spark makes.

A step is one pass over the persisted design: each partition adds up small records per risk set in numpy, these are
summed by risk set, tasks turn risk sets into terms of the likelihood, and the driver sees sums of the size of the coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.trajectory import linear_predictor, sigmoid
from ..session import discard, staged
from .ranks import FEW, running_sum


@dataclass
class HazardModel:
    """Coefficients with the means that they are centred on and their standard errors."""

    columns: list[str]
    beta: np.ndarray
    mean: np.ndarray
    se: np.ndarray
    log_likelihood: float = float("nan")
    steps: int = 0

    def score(self, rows: DataFrame, name: str = "ps") -> DataFrame:
        """Partial hazard exp((x - mean) . beta)."""
        return rows.withColumn(name, F.exp(linear_predictor(self.columns, self.beta.tolist(), self.mean.tolist())))

    def predictor(self, rows: DataFrame, name: str = "eta") -> DataFrame:
        return rows.withColumn(name, linear_predictor(self.columns, self.beta.tolist(), self.mean.tolist()))

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per coefficient."""
        rows = [(i, c, float(b), float(m), float(s)) for i, (c, b, m, s) in enumerate(zip(self.columns, self.beta, self.mean, self.se, strict=True))]
        spark.createDataFrame(rows, "place int, name string, beta double, mean double, se double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HazardModel:
        rows = spark.read.parquet(path).orderBy("place").collect()
        take = lambda c: np.array([r[c] for r in rows], float)
        return cls([r["name"] for r in rows], take("beta"), take("mean"), take("se"))


def moments(p: int) -> list[str]:
    """Names of a risk set's sums: weight, weight * x, weight * x x' (upper triangle)."""
    return ["s0", *(f"s1_{i}" for i in range(p)), *(f"s2_{i}_{j}" for i in range(p) for j in range(i, p))]


def partial_sums(design: DataFrame, columns: list[str], event: str, group: str, beta: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> DataFrame:
    """group, deaths, eta and x summed over deaths, and the weighted moments of all rows and of deaths, per partition."""
    p = len(columns)
    upper = np.triu_indices(p)
    names = ["deaths", "eta", *(f"x_{i}" for i in range(p)), *moments(p), *(f"d_{m}" for m in moments(p))]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            x = (np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]) - centre) / scale
            d = batch.column(event).to_numpy(zero_copy_only=False).astype(float)
            key = batch.column(group).to_numpy(zero_copy_only=False)
            eta = np.clip(x @ beta, -500, 500)
            w = np.exp(eta)
            weighed = np.column_stack([w, w[:, None] * x, w[:, None] * x[:, upper[0]] * x[:, upper[1]]])
            rows = np.column_stack([d, d * eta, d[:, None] * x, weighed, d[:, None] * weighed])
            kinds, back = np.unique(key, return_inverse=True)
            total = np.zeros((len(kinds), rows.shape[1]))
            np.add.at(total, back, rows)
            for k, row in zip(kinds.tolist(), total):
                held[k] = held[k] + row if k in held else row
        if held:
            values = np.array(list(held.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *(pa.array(c) for c in values.T)], [group, *names])

    schema = f"{group} long, " + ", ".join(f"{n} double" for n in names)
    made = design.select(F.col(group).cast("long").alias(group), F.col(event).cast("double").alias(event), *columns).mapInArrow(sums, schema)
    return made.groupBy(group).agg(*(F.sum(n).alias(n) for n in names))


#: Rows of a task that are added up at once.
ROWS_AT_ONCE = 1 << 16


def group_moments(x: np.ndarray, d: np.ndarray, key: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of ``key`` and for each a row of deaths, eta and x over deaths, and the moments of all rows and of deaths, by matrix products."""
    order = np.argsort(key, kind="stable")
    x, d, key = x[order], d[order], key[order]
    ends = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    eta = np.clip(x @ beta, -500, 500)
    one = np.column_stack([np.ones(len(x)), x])
    weighed, upper = np.exp(eta)[:, None] * one, np.triu_indices(x.shape[1] + 1)
    out = []
    for lo, hi in zip(ends[:-1], ends[1:]):
        own, dead = one[lo:hi], np.flatnonzero(d[lo:hi]) + lo
        fallen = d[dead]
        out.append(np.concatenate([[fallen.sum(), fallen @ eta[dead]], fallen @ x[dead], (weighed[lo:hi].T @ own)[upper], (weighed[dead].T @ (fallen[:, None] * one[dead]))[upper]]))
    return key[ends[:-1]], np.array(out)


def likelihood(design: DataFrame, columns: list[str], event: str, group: str, beta: np.ndarray, centre: np.ndarray, scale: np.ndarray, ties: str) -> tuple[float, np.ndarray, np.ndarray]:
    """``efron`` of ``partial_sums`` for designs of many columns: a risk set's sums travel as one array.

    Tasks add up their rows, then whole risk sets; the driver adds a row a task of the coefficients' size.
    """
    p = len(columns)
    moved, upper = 1 + p + p * (p + 1) // 2, np.triu_indices(p)

    def added(held: dict[int, np.ndarray], keys, rows) -> None:
        for k, row in zip(keys.tolist(), rows):
            held[k] = held[k] + row if k in held else row

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        waiting, n = [], 0

        def flush() -> None:
            table = pa.Table.from_batches(waiting)
            take = lambda c: table.column(c).to_numpy()
            x = (np.column_stack([take(c).astype(float) for c in columns]) - centre) / scale
            added(held, *group_moments(x, take(event).astype(float), take(group), beta))

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
            if n >= ROWS_AT_ONCE:
                flush()
                waiting, n = [], 0
        if n:
            flush()
        if held:
            values = np.array(list(held.values()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), lists], [group, "sums"])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                added(held, batch.column(group).to_numpy(), batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, -1))
        rows = np.array([v for v in held.values() if v[0] > 0])
        if len(rows):

            def unpack(m: np.ndarray) -> list[np.ndarray]:
                square = np.zeros((len(m), p, p))
                square[:, upper[0], upper[1]] = m[:, 1 + p :]
                square[:, upper[1], upper[0]] = m[:, 1 + p :]
                return [m[:, 0], m[:, 1 : 1 + p], square]

            ll, score, info = risk_set_terms(rows[:, 0], unpack(rows[:, 2 + p : 2 + p + moved]), unpack(rows[:, 2 + p + moved :]), ties)
            row = np.concatenate([[rows[:, 1].sum() - ll], rows[:, 2 : 2 + p].sum(0) - score, info[upper]])
            yield pa.RecordBatch.from_arrays([pa.array([row.tolist()], pa.list_(pa.float64()))], ["terms"])

    made = design.select(F.col(group).cast("long").alias(group), F.col(event).cast("double").alias(event), *[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(sums, f"{group} long, sums array<double>")
    found = [r["terms"] for r in made.repartition(group).mapInArrow(terms, "terms array<double>").collect()]
    row = np.sum(np.array(found), axis=0) if found else np.zeros(moved)
    info = np.zeros((p, p))
    info[upper] = row[1 + p :]
    return float(row[0]), row[1 : 1 + p], info + np.triu(info, 1).T


#: The smallest factors of a falling product that are taken one by one; the rest is in closed form.
DIRECT = 16


def falling_sums(top: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over k < n of log(top - k), 1 / (top - k) and 1 / (top - k) ** 2, for top >= n: in time that does not grow with n.

    Differences of log-gamma, digamma and trigamma, by their asymptotic series from DIRECT + 1 on, written so that large
    arguments do not cancel.
    """
    least, few = top - n + 1, np.minimum(n, DIRECT)
    logs, first, second = (np.zeros(len(top)) for _ in range(3))
    for j in range(DIRECT):
        on = few > j
        x = least[on] + j
        logs[on] += np.log(x)
        first[on] += 1 / x
        second[on] += 1 / x**2
    on = n > DIRECT
    x, y = least[on] + DIRECT, top[on] + 1
    gap, inverse, other = n[on] - DIRECT, 1 / x, 1 / y
    apart = lambda k: other**k - inverse**k
    logs[on] += (x - 0.5) * np.log1p(gap / x) + gap * np.log(y) - gap + apart(1) / 12 - apart(3) / 360 + apart(5) / 1260 - apart(7) / 1680
    first[on] += np.log1p(gap / x) - apart(1) / 2 - apart(2) / 12 + apart(4) / 120 - apart(6) / 252 + apart(8) / 240
    second[on] += gap * inverse * other - apart(2) / 2 - apart(3) / 6 + apart(5) / 30 - apart(7) / 42 + apart(9) / 30
    return logs, first, second


def risk_set_terms(deaths: np.ndarray, risk: list[np.ndarray], dead: list[np.ndarray], ties: str) -> tuple[float, np.ndarray, np.ndarray]:
    """What risk sets take from the log likelihood, the score and the information; moments of order 0, 1 and 2 of all rows and of deaths.

    Efron's d terms divide by s0 - k / d * d0 for k < d, which is d0 / d times a falling product's factor, so that all sums over k are
    closed; Breslow's are d equal ones.
    """
    s0, s1, s2 = risk
    d0, d1, d2 = dead
    d = np.rint(deaths)
    outer = lambda a, b: np.einsum("ni,nj->nij", a, b)
    if ties != "efron":
        m = s1 / s0[:, None]
        return float((d * np.log(s0)).sum()), (d[:, None] * m).sum(0), (d[:, None, None] * (s2 / s0[:, None, None] - outer(m, m))).sum(0)
    logs, r1, r2 = falling_sums(np.maximum(d * s0 / d0, d), d)
    unit = d / d0
    logs, r1, r2 = logs - d * np.log(unit), r1 * unit, r2 * unit**2
    # sums of phi / a, phi / a ** 2 and phi ** 2 / a ** 2, as phi = (s0 - a) / d0
    f1, f2, f3 = (s0 * r1 - d) / d0, (s0 * r2 - r1) / d0, (s0 * (s0 * r2 - 2 * r1) + d) / d0**2
    cross = outer(s1, d1)
    square = outer(s1, s1) * r2[:, None, None] - (cross + cross.transpose(0, 2, 1)) * f2[:, None, None] + outer(d1, d1) * f3[:, None, None]
    return float(logs.sum()), (s1 * r1[:, None] - d1 * f1[:, None]).sum(0), (s2 * r1[:, None, None] - d2 * f1[:, None, None] - square).sum(0)


def efron(sums: DataFrame, p: int, ties: str = "efron") -> tuple[float, np.ndarray, np.ndarray]:
    """Log partial likelihood, score and information from sums per risk set. Tasks add up risk sets; the driver sees one row."""
    upper = np.triu_indices(p)
    names = ["ll", *(f"u_{i}" for i in range(p)), *(f"i_{k}" for k in range(len(upper[0])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            take = lambda names: np.column_stack([batch.column(c).to_numpy() for c in names])

            def unpack(prefix: str) -> list[np.ndarray]:
                m = take([f"{prefix}{c}" for c in moments(p)])
                square = np.zeros((len(m), p, p))
                square[:, upper[0], upper[1]] = m[:, 1 + p :]
                square[:, upper[1], upper[0]] = m[:, 1 + p :]
                return [m[:, 0], m[:, 1 : 1 + p], square]

            ll, score, info = risk_set_terms(batch.column("deaths").to_numpy(), unpack(""), unpack("d_"), ties)
            row = np.concatenate([[batch.column("eta").to_numpy().sum() - ll], take([f"x_{i}" for i in range(p)]).sum(0) - score, info[upper]])
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names)

    total = sums.where("deaths > 0").mapInArrow(run, ", ".join(f"{n} double" for n in names)).agg(*(F.sum(n) for n in names)).first()
    row = np.array([v or 0.0 for v in total])
    info = np.zeros((p, p))
    info[upper] = row[1 + p :]
    return float(row[0]), row[1 : 1 + p], info + np.triu(info, 1).T


#: Levels of the tree of event times that one group of ``interval_sums`` holds: its rows are at most some 2 ** LEVELS times three.
LEVELS = 12


def event_index(rows: DataFrame, start: str, stop: str, event: str) -> tuple[DataFrame, int]:
    """``rows`` with ``lo_`` and ``hi_``, the first and last place of an event time in (start, stop], and how many event times there are.

    Rows whose interval is empty, unknown or holds no event time are left out. Places come from running sums by ranges of values.
    """
    known = rows.where((F.col(start) < F.col(stop)) & ~F.isnan(F.col(start).cast("double")) & ~F.isnan(F.col(stop).cast("double")))
    ends = known.select(F.explode(F.array(F.struct(F.col(start).cast("double").alias("t_"), F.lit(0).alias("e_")), F.struct(F.col(stop).cast("double").alias("t_"), (F.col(event) > 0).cast("int").alias("e_")))).alias("p_"))
    times = staged(ends.groupBy(F.col("p_.t_").alias("t_")).agg(F.max(F.coalesce("p_.e_", F.lit(0))).alias("e_")), "event-times")
    n = times.agg(F.sum("e_")).first()[0] or 0
    few = times.count() <= FEW
    places = staged(running_sum(times, "t_", "e_", "before_").select("t_", (F.col("before_") + F.col("e_")).cast("long").alias("upto_")), "event-places")
    discard(times)
    for column, name in ((start, "lo_"), (stop, "hi_")):
        side = places.select(F.col("t_").alias(f"at_{name}"), F.col("upto_").alias(name))
        known = known.join(F.broadcast(side) if few else side, F.col(column).cast("double") == F.col(f"at_{name}")).drop(f"at_{name}")
    return known.withColumn("hi_", F.col("hi_") - 1).where("lo_ <= hi_"), int(n)


def interval_sums(held: DataFrame, columns: list[str], event: str, n: int, beta: np.ndarray, centre: np.ndarray, scale: np.ndarray, levels: int = LEVELS) -> tuple[DataFrame, list[DataFrame]]:
    """As ``partial_sums``, and the stored tables that it reads, for rows at risk from event place ``lo_`` to ``hi_`` of ``n``: a row for each event time.

    A row counts in the few nodes of a binary tree over the places that make up its span, so nothing is listed once an event time and
    no sum is taken from another. An event time's risk set is the sum of the nodes above it, which groups of ``levels`` levels
    add up, from the root down.
    """
    p = len(columns)
    upper = np.triu_indices(p)
    names = ["deaths", "eta", *(f"x_{i}" for i in range(p)), *moments(p)]
    schema = "level int, node long, " + ", ".join(f"{m} double" for m in names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = (np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]) - centre) / scale
            d = batch.column(event).to_numpy(zero_copy_only=False).astype(float)
            eta = np.clip(x @ beta, -500, 500)
            w = np.exp(eta)
            weighed = np.column_stack([w, w[:, None] * x, w[:, None] * x[:, upper[0]] * x[:, upper[1]]])
            low, high = batch.column("lo_").to_numpy(), batch.column("hi_").to_numpy() + 1
            dead = np.flatnonzero(d > 0)
            parts = [(-1, high[dead] - 1, np.column_stack([d, d * eta, d[:, None] * x, d[:, None] * weighed])[dead])]
            plain = np.column_stack([np.zeros((len(x), 2 + p)), weighed])
            level = 0
            while (low < high).any():
                odd = (low < high) & (low & 1 == 1)
                parts.append((level, low[odd], plain[odd]))
                low = low + odd
                odd = (low < high) & (high & 1 == 1)
                high = high - odd
                parts.append((level, high[odd], plain[odd]))
                low, high, level = low >> 1, high >> 1, level + 1
            for level, node, rows in parts:
                if len(node):
                    kinds, back = np.unique(node, return_inverse=True)
                    total = np.zeros((len(kinds), rows.shape[1]))
                    np.add.at(total, back, rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), level, np.int32)), pa.array(kinds), *(pa.array(c) for c in total.T)], ["level", "node", *names])

    nodes = held.select("lo_", "hi_", F.col(event).cast("double").alias(event), *columns).mapInArrow(spread, schema).groupBy("level", "node").agg(*(F.sum(m).alias(m) for m in names))
    depth, stored = max(1, (n - 1).bit_length() + 1), []
    if depth > levels:  # several groups of levels read them
        nodes = staged(nodes, "risk-nodes")
        stored.append(nodes)
    sums = moments(p)
    last = [*names[: 2 + p], *sums, *(f"d_{m}" for m in sums)]

    def gather(low: int, out: list[str]):
        def run(table: pa.Table) -> pa.Table:
            level, node = table.column("level").to_numpy(), table.column("node").to_numpy()
            values = np.column_stack([table.column(c).to_numpy() for c in names])
            asked = np.flatnonzero(level == -1)
            at, total = node[asked], np.zeros((len(asked), len(sums)))
            for k in np.unique(level[level >= 0]):
                own = np.flatnonzero(level == k)
                own = own[np.argsort(node[own])]
                place = np.searchsorted(node[own], at >> (int(k) - low)).clip(0, len(own) - 1)
                hit = node[own[place]] == at >> (int(k) - low)
                total[hit] += values[own[place[hit]], 2 + p :]
            made = {**dict(zip(names[: 2 + p], values[asked, : 2 + p].T)), **dict(zip(sums, total.T)), **{f"d_{m}": c for m, c in zip(sums, values[asked, 2 + p :].T)}}
            return pa.table([pa.array(at), *(pa.array(made[c]) for c in out)], ["node", *out])

        return run

    base = None
    for low in range((depth - 1) // levels * levels, -1, -levels):
        top = low + levels
        own = nodes.where((F.col("level") >= low) & (F.col("level") < top)).withColumn("range_", F.expr(f"shiftright(node, {top} - level)"))
        asked = nodes.where("level = -1")
        if low:
            asked = asked.select(F.lit(-1).alias("level"), F.shiftright("node", low).alias("node")).distinct().select("*", *(F.lit(0.0).alias(m) for m in names))
        rows = own.unionByName(asked.withColumn("range_", F.shiftright("node", levels)))
        if base is not None:
            rows = rows.unionByName(base.select(F.lit(top).alias("level"), "node", *(F.lit(0.0).alias(m) for m in names[: 2 + p]), *sums, F.col("node").alias("range_")))
        out = sums if low else last
        made = rows.groupBy("range_").applyInArrow(gather(low, out), "node long, " + ", ".join(f"{c} double" for c in out))
        base = made
    return base.withColumnRenamed("node", "place"), stored


def column_moments(design: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population standard deviations, 1 where a column is constant."""
    row = design.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)]).first()
    mean = np.array([row[f"m_{i}"] or 0.0 for i in range(len(columns))])
    sd = np.array([row[f"s_{i}"] or 0.0 for i in range(len(columns))])
    return mean, np.where(sd > 1e-12, sd, 1.0)


def fit_cox(
    design: DataFrame, columns: list[str], event: str = "treatment", group: str | None = "bin_idx", ties: str = "efron", ridge: float = 1e-6, steps: int = 30, tolerance: float = 1e-7, start: str = "start", stop: str = "stop", levels: int = LEVELS
) -> HazardModel:
    """Time-varying Cox model; a small ridge holds constant and collinear columns.

    Rows of aligned bins: ``group`` names the bin. General intervals (start, stop]: ``group=None``; a row is at risk at every event
    time in its interval and has its event at its stop.
    """
    if group is None:
        rows, n = event_index(design.select(start, stop, event, *columns), start, stop, event)
        held = rows.select("lo_", "hi_", event, *columns).persist(StorageLevel.MEMORY_AND_DISK)
    else:
        held = design.select(group, event, *columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        mean, sd = column_moments(held, columns)
        p = len(columns)

        def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            if group is None:
                sums, stored = interval_sums(held, columns, event, n, beta, mean, sd, levels)
                made = efron(sums, p, ties)
                discard(*stored)
                return made
            return likelihood(held, columns, event, group, beta, mean, sd, ties)

        beta = np.zeros(p)
        now = at(beta)
        step_no = 0
        for step_no in range(1, steps + 1):
            ll, score, info = now
            move = np.linalg.solve(info + ridge * np.eye(p), score - ridge * beta)
            part = 1.0
            while True:
                tried = beta + part * move
                made = at(tried)
                if made[0] - ridge / 2 * tried @ tried >= ll - ridge / 2 * beta @ beta - 1e-9 or part < 1e-4:
                    break
                part /= 2
            beta, now = tried, made
            # collinear columns leave moves of rounding noise, whatever its size: what the likelihood gained is below its last digits
            if np.abs(part * move).max() < tolerance or move @ (score - ridge * (beta - part * move)) < 1e-14 * max(abs(ll), 1.0):
                break
        cov = np.linalg.inv(now[2] + ridge * np.eye(p))
        return HazardModel(columns, beta / sd, mean, np.sqrt(np.maximum(np.diag(cov), 0)) / sd, now[0], step_no)
    finally:
        held.unpersist()


#: Groups that are returned to the driver as model objects.
MAX_GROUPS = 10_000


def score_pass(design: DataFrame, columns: list[str], beta: list[float], event: str = "treatment", group: str = "bin_idx") -> DataFrame:
    """bin_idx, deaths, s0, s1_i: the sums of one pass at fixed coefficients, for checking and for custom solvers."""
    p = len(columns)
    made = partial_sums(design, columns, event, group, np.array(beta), np.zeros(p), np.ones(p))
    return made.select(F.col(group).cast("int").alias(group), "deaths", "s0", *(f"s1_{i}" for i in range(p)))


def fit_discrete(rows: DataFrame, columns: list[str], event: str = "y_event", risk: str = "at_risk", steps: int = 25, ridge: float = 1e-6) -> HazardModel:
    """Discrete-time hazard: a logistic regression over person-time at risk; the last coefficient is the intercept."""
    return fit_grouped_logistic(rows.where(F.col(risk) > 0).withColumn("one_", F.lit(0)), columns, event, "one_", steps, ridge)[0]


def grouped_logistic(rows: DataFrame, columns: list[str], event: str, group: str, steps: int = 25, ridge: float = 1e-3) -> DataFrame:
    """group, beta, variance (of columns and, last, the intercept): a logistic regression for each value of ``group``, fitted in the same passes.

    A pass joins rows with their group's coefficients, adds up score and information in each batch and then by group, and takes
    all Newton steps in tasks. Coefficients stay a table, stored after each pass; the driver sees the largest move. A hot
    group's rows may lie in many tasks. Rows without a group are left out.
    """
    held = rows.select(F.col(group).cast("long").alias("g_"), F.col(event).cast("double").alias("y_"), *[F.col(c).cast("double").alias(f"x_{i}") for i, c in enumerate(columns)])
    held = held.where("g_ is not null").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        inputs = [f"x_{i}" for i in range(len(columns))]
        mean, sd = column_moments(held, inputs) if inputs else (np.zeros(0), np.ones(0))
        q = len(columns) + 1
        upper = np.triu_indices(q)
        names = [*(f"s{i}" for i in range(q)), *(f"h{i}" for i in range(len(upper[0])))]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.column_stack([*((batch.column(c).to_numpy(zero_copy_only=False) - m) / s for c, m, s in zip(inputs, mean, sd)), np.ones(batch.num_rows)])
                key, first, back = np.unique(batch.column("g_").to_numpy(), return_index=True, return_inverse=True)
                beta = batch.column("beta").flatten().to_numpy().reshape(-1, q)
                p = 1 / (1 + np.exp(-np.clip((x * beta).sum(1), -30, 30)))
                made = np.column_stack([x * (batch.column("y_").to_numpy(zero_copy_only=False) - p)[:, None], (p * (1 - p))[:, None] * x[:, upper[0]] * x[:, upper[1]]])
                added = np.zeros((len(key), made.shape[1]))
                np.add.at(added, back, made)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("beta").take(pa.array(first)), *(pa.array(c) for c in added.T)], ["g_", "beta", *names])

        def newton(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                beta = batch.column("beta").flatten().to_numpy().reshape(-1, q)
                made = np.column_stack([batch.column(n).to_numpy() for n in names])
                info = np.zeros((len(made), q, q))
                info[:, upper[0], upper[1]] = info[:, upper[1], upper[0]] = made[:, q:]
                info += ridge * np.eye(q)
                move = np.linalg.solve(info, (made[:, :q] - ridge * beta)[:, :, None])[:, :, 0]
                move /= np.maximum(1.0, np.abs(move).max(1, keepdims=True) / 4)
                variance = np.diagonal(np.linalg.inv(info), axis1=1, axis2=2)
                yield pa.RecordBatch.from_arrays([batch.column("g_"), pa.array(list(beta + move), pa.list_(pa.float64())), pa.array(list(variance), pa.list_(pa.float64())), pa.array(np.abs(move).max(1))], ["g_", "beta", "variance", "move"])

        zeros = F.array(*[F.lit(0.0)] * q)
        now = staged(held.select("g_").distinct().select("g_", zeros.alias("beta"), zeros.alias("variance"), F.lit(0.0).alias("move")), "time-coefficients")
        for _ in range(steps):
            added = held.join(now.select("g_", "beta"), "g_").mapInArrow(sums, "g_ long, beta array<double>, " + ", ".join(f"{n} double" for n in names))
            added = added.groupBy("g_").agg(F.first("beta").alias("beta"), *(F.sum(n).alias(n) for n in names))
            before, now = now, staged(added.mapInArrow(newton, "g_ long, beta array<double>, variance array<double>, move double"), "time-coefficients")
            discard(before)
            if (now.agg(F.max("move")).first()[0] or 0.0) < 1e-7:
                break
        own = [F.get("beta", F.lit(i)) / float(s) for i, s in enumerate(sd)]
        shift = sum((b * float(m) for b, m in zip(own, mean)), F.lit(0.0))
        spread = [F.get("variance", F.lit(i)) / float(s) ** 2 for i, s in enumerate([*sd, 1.0])]
        return now.select(F.col("g_").alias(group), F.array(*own, F.get("beta", F.lit(q - 1)) - shift).alias("beta"), F.array(*spread).alias("variance"))
    finally:
        held.unpersist()


def fit_grouped_logistic(rows: DataFrame, columns: list[str], event: str, group: str, steps: int = 25, ridge: float = 1e-3) -> dict[int, HazardModel]:
    """The regressions of ``grouped_logistic`` as model objects, for ``MAX_GROUPS`` groups at most; more are an error before any pass."""
    n = rows.select(F.col(group).cast("long")).distinct().count()
    if n > MAX_GROUPS:
        raise ValueError(f"{n} groups, more than {MAX_GROUPS}: take grouped_logistic, which keeps coefficients in a table")
    names, none = [*columns, "intercept"], np.zeros(len(columns) + 1)
    made = grouped_logistic(rows, columns, event, group, steps, ridge).collect()
    return {r[group]: HazardModel(names, np.array(r["beta"]), none, np.sqrt(np.maximum(np.array(r["variance"]), 0))) for r in made}


def time_propensity(rows: DataFrame, columns: list[str], event: str, group: str) -> DataFrame:
    """``rows`` with ``ps``, the probability by the regression of their own time; any number of times. Rows without a time are left out."""
    table = grouped_logistic(rows, columns, event, group).select(F.col(group).alias("g_"), F.col("beta").alias("beta_"))
    eta = F.get("beta_", F.lit(len(columns)))
    for i, c in enumerate(columns):
        eta = eta + F.col(c).cast("double") * F.get("beta_", F.lit(i))
    return rows.join(table, F.col(group).cast("long") == F.col("g_")).withColumn("ps", sigmoid(eta)).drop("g_", "beta_")
