"""End-to-end plans and model objects that users call: fit, embed, score, save, load."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.trajectory import Classifier, decline_flags, four_class_flags, increase_flags
from ..operators import binning, cox, design, riskset, sequences, summaries
from ..session import by_key, staged

STATIC = ["age", "sex", "cci", "Tmax"]
#: Classifiers that a stored model names; any other is given to ``load``.
CLASSIFIERS = {f.__name__: f for f in (decline_flags, increase_flags, four_class_flags)}


def feature_slice(dynamic: DataFrame, lab: str) -> DataFrame:
    """patient_id, time, lab_value of one lab."""
    return dynamic.where(F.col("feature_name") == lab).select(F.col("pid").alias("patient_id"), "time", F.col("value").alias("lab_value"))


def long_labs(dynamic: DataFrame, labs: list[str]) -> DataFrame:
    """patient_id, lab, time, lab_value of some labs: one scan for all."""
    return dynamic.where(F.col("feature_name").isin(labs)).select(F.col("pid").alias("patient_id"), F.col("feature_name").alias("lab"), "time", F.col("value").alias("lab_value"))


def lab_wide(dynamic: DataFrame, labs: list[str]) -> DataFrame:
    """patient_id, time and a column for each lab."""
    rows = dynamic.where(F.col("feature_name").isin(labs)).groupBy(F.col("pid").alias("patient_id"), "time")
    return rows.pivot("feature_name", labs).agg(F.max("value"))


def prepare_prototype(dynamic: DataFrame, static: DataFrame, embed: list[str], aggregate: list[str], width: float = 1.0) -> DataFrame:
    """Bins with last or mean covariates and the embedded features' values, masks and gaps at their starts."""
    kept = dynamic.where(F.col("feature_name").isin([*embed, *aggregate]))
    bins = binning.aggregate_last(kept, static, aggregate, width)
    return bins.join(by_key(sequences.sequences_on_bins(kept, bins.select("pid", "bin_idx", "start"), embed)), ["pid", "bin_idx"])


def onset_only(rows: DataFrame) -> DataFrame:
    """Bins up to the first treated one, which is the only event; ``treatment`` in every later bin is not one."""
    made = binning.event_targets(rows, onset="onset_", risk="risk_").where("risk_ > 0")
    return made.withColumn("treatment", F.col("onset_").cast("int")).drop("onset_", "risk_")


@dataclass
class CoxPropensity:
    """Cox model on a counting-process design whose trajectory columns a subclass makes.

    ``fills`` are the medians that ``fit`` found for bins without a value; later tables are filled with them, not with their own.
    """

    labs: list[str]
    aggregate: list[str]
    width: float = 1.0
    event_mode: str = "status"
    static_cols: list[str] = field(default_factory=lambda: list(STATIC))
    model: cox.HazardModel | None = None
    fills: dict[str, float | None] = field(default_factory=dict)

    def embed(self, dynamic: DataFrame) -> DataFrame:
        """patient_id, time and the trajectory columns of all labs."""
        raise NotImplementedError

    def aligned(self, embedded: DataFrame, bins: DataFrame) -> DataFrame:
        values = [c for c in embedded.columns if c not in ("patient_id", "time")]
        return design.align_rows(bins, embedded, values)

    def design(self, dynamic: DataFrame, static: DataFrame, learn: bool = False) -> DataFrame:
        """The counting process; ``learn`` keeps the medians of these bins."""
        fills = {} if learn else self.fills or None
        bins = binning.aggregate_to_bins(dynamic, static, self.aggregate, self.width, fills=fills)
        self.fills = fills if learn else self.fills
        made = design.counting_process(static, bins, self.aligned(self.embed(dynamic), bins), self.static_cols)
        return onset_only(made) if self.event_mode == "onset" else made

    def covariates(self, rows: DataFrame) -> list[str]:
        return [c for c in rows.columns if c not in ("pid", "bin_idx", "start", "stop", "treatment")]

    def fit(self, dynamic: DataFrame, static: DataFrame) -> DataFrame:
        """Fit and return the design with ``ps``. The design is stored for the passes and the score."""
        rows = staged(self.design(dynamic, static, learn=True), "design")
        self.model = cox.fit_cox(rows, self.covariates(rows))
        return self.model.score(rows)

    def ps(self, dynamic: DataFrame, static: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("fit or load first")
        return self.model.score(self.design(dynamic, static))

    def settings(self) -> dict:
        """What ``save`` keeps besides the coefficients."""
        return {c: getattr(self, c) for c in ("labs", "aggregate", "width", "event_mode", "static_cols", "fills")}

    def save(self, spark: SparkSession, path: str) -> None:
        """Two tables under ``path``: settings (one row) and coefficients."""
        if self.model is None:
            raise ValueError("fit or load first")
        write_settings(spark, path, self)
        self.model.save(spark, f"{path}/coefficients")

    def restore(self, spark: SparkSession, path: str) -> None:
        self.model = cox.HazardModel.load(spark, f"{path}/coefficients")


@dataclass
class PosteriorPropensity(CoxPropensity):
    """Trajectory class probabilities from spline posteriors."""

    config: summaries.PosteriorConfig = field(default_factory=summaries.PosteriorConfig)
    classifier: Classifier = decline_flags
    thresholds: dict[str, float] = field(default_factory=dict)

    def embed(self, dynamic: DataFrame) -> DataFrame:
        return summaries.trajectory_probabilities(long_labs(dynamic, self.labs), self.config, self.classifier, **self.thresholds)

    def aligned(self, embedded: DataFrame, bins: DataFrame) -> DataFrame:
        embedded = staged(embedded, "embedded")  # each lab reads it
        return design.align_by_lab(bins, {lab: embedded.where(F.col("lab") == lab).drop("lab") for lab in self.labs})

    def settings(self) -> dict:
        name = getattr(self.classifier, "__name__", "")
        return {**super().settings(), "config": asdict(self.config), "thresholds": self.thresholds, "classifier": name if CLASSIFIERS.get(name) is self.classifier else None}


@dataclass
class GamPropensity(CoxPropensity):
    """Penalised-spline coefficients."""

    config: summaries.GamConfig = field(default_factory=summaries.GamConfig)

    def embed(self, dynamic: DataFrame) -> DataFrame:
        return summaries.gam_covariates(long_labs(dynamic, self.labs), self.labs, self.config)

    def settings(self) -> dict:
        return {**super().settings(), "config": asdict(self.config)}


@dataclass
class SequencePropensity:
    """Recurrent embeddings with a linear binned Cox head over [embedding, STD, Z]."""

    embed_features: list[str]
    aggregate: list[str]
    weights: dict[str, np.ndarray]
    width: float = 1.0
    head: cox.HazardModel | None = None

    @property
    def hidden(self) -> int:
        return sequences.hidden_size(self.weights)

    def embed(self, dynamic: DataFrame, static: DataFrame) -> DataFrame:
        """Samples with H_raw and H_agg."""
        samples = sequences.sequence_samples(dynamic, static, self.embed_features, self.aggregate, self.width)
        return sequences.gather_steps(sequences.encode(samples, self.weights), "H_raw", "idx_map", self.hidden)

    def steps(self, embedded: DataFrame) -> DataFrame:
        """pid, t_idx, time, y_event, at_risk and the inputs of the head, masked before the first raw step."""
        zipped = F.arrays_zip("agg_time", "y_event", "at_risk", "idx_map", "STD_agg", "H_agg")
        rows = embedded.select("pid", "Z", F.posexplode(zipped).alias("t_idx", "s"))
        inputs = [F.get("s.H_agg", F.lit(i)).alias(f"h{i + 1}") for i in range(self.hidden)]
        inputs += [F.get("s.STD_agg", F.lit(i)).alias(f"std{i + 1}") for i in range(len(self.aggregate))] + [F.get("Z", F.lit(i)).alias(f"z{i + 1}") for i in range(3)]
        return riskset.history_mask(rows.select("pid", "t_idx", F.col("s.agg_time").alias("time"), F.col("s.y_event").alias("y_event"), F.col("s.at_risk").alias("at_risk"), F.col("s.idx_map").alias("idx_map"), *inputs))

    def inputs(self) -> list[str]:
        return [*(f"h{i + 1}" for i in range(self.hidden)), *(f"std{i + 1}" for i in range(len(self.aggregate))), "z1", "z2", "z3"]

    def fit(self, dynamic: DataFrame, static: DataFrame, ridge: float = 1e-3) -> cox.HazardModel:
        """The head by Newton passes with Breslow ties: the binned Cox loss over whole risk sets."""
        rows = self.steps(self.embed(dynamic, static)).where("at_risk > 0")
        self.head = cox.fit_cox(rows, self.inputs(), "y_event", "t_idx", ties="breslow", ridge=ridge)
        return self.head

    def ps(self, dynamic: DataFrame, static: DataFrame, by: str = "t_idx") -> DataFrame:
        """patient_id, t_idx, time, eta, at_risk, ps."""
        rows = riskset.riskset_softmax(self.head.predictor(self.steps(self.embed(dynamic, static))), by)
        return rows.select(F.col("pid").alias("patient_id"), "t_idx", "time", "eta", (F.col("at_risk") > 0).alias("at_risk"), "ps")

    def embeddings(self, dynamic: DataFrame, static: DataFrame) -> DataFrame:
        """pid, t_idx, time, h1..: one row for each bin."""
        rows = self.steps(self.embed(dynamic, static))
        return rows.select("pid", "t_idx", "time", *[f"h{i + 1}" for i in range(self.hidden)])

    def settings(self) -> dict:
        return {c: getattr(self, c) for c in ("embed_features", "aggregate", "width")}

    def save(self, spark: SparkSession, path: str) -> None:
        """Three tables under ``path``: settings (one row), the encoder's weights and the head's coefficients."""
        if self.head is None:
            raise ValueError("fit or load first")
        write_settings(spark, path, self)
        rows = [(name, list(w.shape), w.ravel().tolist()) for name, w in self.weights.items()]
        spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
        self.head.save(spark, f"{path}/coefficients")

    def restore(self, spark: SparkSession, path: str) -> None:
        self.weights = {w["name"]: np.array(w["numbers"]).reshape(w["shape"]) for w in spark.read.parquet(f"{path}/weights").collect()}
        self.head = cox.HazardModel.load(spark, f"{path}/coefficients")


KINDS = {k.__name__: k for k in (PosteriorPropensity, GamPropensity, SequencePropensity)}
CONFIGS = {"PosteriorPropensity": summaries.PosteriorConfig, "GamPropensity": summaries.GamConfig}


def write_settings(spark: SparkSession, path: str, model: CoxPropensity | SequencePropensity) -> None:
    made = spark.createDataFrame([(type(model).__name__, json.dumps(model.settings()))], "kind string, settings string")
    made.coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load(spark: SparkSession, path: str, classifier: Classifier | summaries.CurveClassifier | None = None) -> CoxPropensity | SequencePropensity:
    """The model that ``save`` wrote, ready to score new tables. ``classifier`` only where the model had one of its own: code is not stored."""
    row = spark.read.parquet(f"{path}/settings").first()
    kind, settings = row["kind"], json.loads(row["settings"])
    if kind in CONFIGS:
        settings["config"] = CONFIGS[kind](**settings["config"])
    if "classifier" in settings:
        settings["classifier"] = classifier or CLASSIFIERS.get(settings["classifier"])
        if settings["classifier"] is None:
            raise ValueError("this model had a classifier of its own: give it as classifier")
    made = KINDS[kind](**settings, **({"weights": {}} if kind == "SequencePropensity" else {}))
    made.restore(spark, path)
    return made
