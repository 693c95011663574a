"""Classifier of incident type and severity (M7, M8), evaluation (M9), batch scoring (M10), top-k decoding (M11) and
model persistence (S5).

One network with a shared trunk and two heads is fitted on a joint loss. Features are scaled by the statistics of the
whole training frame. All rows that are fitted and all that steer early stopping are written as blocks of numbers; every
evaluation of the loss is a Spark job that sums losses and gradients over all blocks. Everything else covers all rows
too: statistics, class counts, evaluation and scoring.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanlens.functions import text
from urbanlens.operators import features as FE
from urbanlens.operators.network import SEVERITY_WEIGHT, TYPE_WEIGHT, Network
from urbanlens.session import written

TRUNK, TYPE_BRANCH, SEVERITY_BRANCH = (64, 32), 16, 8
MAX_ITER, PATIENCE = 50, 10
BLOCK, SLICE = 8192, 1024  # rows stored together, and those put through the network at once (they stay in a core's cache)
FIT_TASKS, TASK_ROWS = 16, 250_000  # tasks of an evaluation at least, and the rows of the frame for which there is one more
BATCH_BYTES_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@dataclass
class IncidentModels:
    """What scoring needs, and what the whole frame's rows say about it."""

    weights: np.ndarray
    layers: dict
    type_labels: list[str]
    severity_labels: list[str]
    feature_cols: list[str]
    stats: dict[str, tuple[float, float]]  # mean and standard deviation of each feature
    type_counts: dict[str, int]
    severity_counts: dict[str, int]

    def network(self) -> Network:
        return Network(len(self.feature_cols), tuple(self.layers["trunk"]), self.layers["type"], self.layers["severity"], len(self.type_labels), len(self.severity_labels))


# ---------------------------------------------------------------- M2, M3: labels and scaler of the whole frame
def frame_statistics(training: DataFrame, feats: list[str]) -> dict:
    """Scaler statistics, label sets and class counts of all rows, from one aggregation by (type, severity).

    Groups are bounded by the kept classes; their means and variances combine exactly to the frame's.
    """
    rows = training.groupBy(FE.TARGET, "severity").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in feats],
        *[F.var_pop(F.col(c).cast("double")).alias(f"v_{c}") for c in feats],
    ).collect()
    if not rows:
        raise ValueError("the training frame has no rows")
    n = np.array([r["n"] for r in rows], float)
    stats = {}
    for c in feats:
        m, v = (np.array([r[f"{k}_{c}"] for r in rows], float) for k in "mv")
        mean = float((n * m).sum() / n.sum())
        std = float(np.sqrt((n * (v + (m - mean) ** 2)).sum() / n.sum()))
        stats[c] = (mean, std if std > 0 else 1.0)
    counts: dict[str, dict[str, int]] = {FE.TARGET: {}, "severity": {}}
    for r in rows:
        for k, found in counts.items():
            found[r[k]] = found.get(r[k], 0) + r["n"]
    return {"stats": stats, "types": dict(sorted(counts[FE.TARGET].items())), "severities": dict(sorted(counts["severity"].items()))}


def _scaled(feats: list[str], stats: dict[str, tuple[float, float]]) -> list[Column]:
    return [(F.col(c).cast("double") - F.lit(stats[c][0])) / F.lit(stats[c][1]) for c in feats]


def fit_tasks(n: int) -> int:
    """Tasks of an evaluation for a frame of ``n`` rows; each sends its gradient to the driver (about 34 kB)."""
    return max(FIT_TASKS, -(-n // TASK_ROWS))


def _blocks(training: DataFrame, feats: list[str], found: dict, seed: int) -> DataFrame:
    """(validates, n, x, types, severities): all rows to fit or to validate as blocks of numbers, in an order that only the
    keys decide."""
    index = lambda labels, c: F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(c)).cast("int") - 1
    role = F.col("role") if "role" in training.columns else F.lit("fit")
    rows = training.filter(((role == "fit") | (role == "validation")))
    n = sum(found["types"].values())  # of the whole frame: how many blocks there are needn't be exact
    parts = -(-n // BLOCK)
    numbers = rows.select("dr_no", (role == "validation").alias("validates"), F.array(*_scaled(feats, found["stats"])).alias("x"),
                          index(found["types"], FE.TARGET).alias("t"), index(found["severities"], "severity").alias("s"))
    numbers = numbers.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "dr_no", "x"), F.lit(parts))).drop("dr_no")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by part; a part is a block of about BLOCK rows and never leaves it far behind
        for batch in batches:
            part, val = np.asarray(batch.column("part")), np.asarray(batch.column("validates").cast(pa.int8()))
            x = np.asarray(batch.column("x").flatten()).reshape(len(part), -1)
            t, s = (np.asarray(batch.column(c)).astype("<i4") for c in "ts")
            keys = sorted(set(zip(val.tolist(), part.tolist(), strict=True)))
            at = [np.flatnonzero((val == v) & (part == p)) for v, p in keys]
            yield pa.RecordBatch.from_arrays([pa.array([bool(v) for v, _ in keys]), pa.array([len(a) for a in at], pa.int64()), *(pa.array([z[a].tobytes() for a in at], pa.binary()) for z in (x, t, s))], names=["validates", "n", "x", "types", "severities"])

    order = ["part", "validates", "t", "s", "x"]
    dealt = numbers.repartition(min(parts, fit_tasks(n)), "part").sortWithinPartitions(*order)
    return dealt.mapInArrow(pack, "validates boolean, n long, x binary, types binary, severities binary")


# ---------------------------------------------------------------- M7, M8: the fit
def dealt_blocks(blocks: DataFrame, tasks: int = FIT_TASKS) -> DataFrame:
    """The blocks over the tasks, each with its blocks in an order that only their contents decide."""
    return blocks.repartition(tasks, F.xxhash64("x", "types", "severities")).sortWithinPartitions("validates", "n", "types", "severities", "x")


class Objective:
    """Losses and gradient of all blocks, each evaluation one Spark job: a row of partial sums comes back for each task
    (see :func:`fit_tasks` and :func:`dealt_blocks`), added up there in the order of its blocks."""

    def __init__(self, blocks: DataFrame, network: Network):
        self.blocks, self.network = blocks, network

    def __call__(self, vector: np.ndarray) -> tuple[float, np.ndarray, float | None]:
        """Mean joint loss of the fitted rows, its gradient, and the mean type loss of the validation rows."""
        network = self.network

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fit, val, slope = [0, 0.0, 0.0], [0, 0.0, 0.0], np.zeros(network.size())
            for batch in batches:
                held = [batch.column(c) for c in ("x", "types", "severities")]
                for i, (validates, n) in enumerate(zip(batch.column("validates").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                    x, *labels = (np.frombuffer(c[i].as_buffer(), k) for c, k in zip(held, ("<f8", "<i4", "<i4"), strict=True))
                    x = x.reshape(n, -1)
                    for some in (slice(at, at + SLICE) for at in range(0, n, SLICE)):
                        if validates:
                            losses, into = network.losses(vector, x[some], [y[some] for y in labels]), val
                        else:
                            losses, steep = network.gradient(vector, x[some], [y[some] for y in labels])
                            slope, into = slope + steep, fit
                        into[:] = [a + b for a, b in zip(into, (len(x[some]), *losses), strict=True)]
            out = [(v, *sums, b"" if v else slope.tobytes()) for v, sums in ((False, fit), (True, val)) if sums[0]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["validates", "n", "type_loss", "severity_loss", "slope"])

        loss, n, val, n_val, slope = 0.0, 0, 0.0, 0, np.zeros(network.size())
        parts = self.blocks.mapInArrow(sums, "validates boolean, n long, type_loss double, severity_loss double, slope binary").collect()
        for r in sorted(parts, key=lambda r: (r.validates, r.n, r.type_loss, r.severity_loss)):  # sums in one order, whatever came first
            if r.validates:
                val, n_val = val + r.type_loss, n_val + r.n
            else:
                loss, n = loss + TYPE_WEIGHT * r.type_loss + SEVERITY_WEIGHT * r.severity_loss, n + r.n
                slope += np.frombuffer(r.slope, "<f8")
        return loss / max(n, 1), slope / max(n, 1), val / n_val if n_val else None


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray, float | None]], x: np.ndarray, max_iter: int, patience: int, memory: int = 10) -> np.ndarray:
    """L-BFGS with halving steps; the vector of the least watched loss.

    Watched is what ``f`` returns third (the validation loss), or the loss itself where that is None. Stops after
    ``patience`` steps without improvement, or when no step improves the loss. Values that aren't numbers are never taken.
    """
    worth = lambda v: v if v is not None and np.isfinite(v) else np.inf
    value, slope, watched = f(x)
    watch = lambda v, w: worth(w) if w is not None else worth(v)
    best, best_watched, bad, past = x, watch(value, watched), 0, []
    for _ in range(max_iter):
        # the two loops of the method over the last steps
        d, kept = slope.copy(), []
        for s, y, r in reversed(past):
            a = r * (s @ d)
            d -= a * y
            kept.append(a)
        if past:
            s, y, _ = past[-1]
            d *= (s @ y) / (y @ y)
        else:
            d /= max(1.0, np.linalg.norm(d))
        for (s, y, r), a in zip(past, reversed(kept), strict=True):
            d += (a - r * (y @ d)) * s
        step, fall = 1.0, slope @ d
        while step > 1e-6:
            moved = x - step * d
            new, new_slope, new_watched = f(moved)
            if worth(new) <= value - 1e-4 * step * fall and np.isfinite(new_slope).all():
                break
            step /= 2
        else:
            break
        s, y = moved - x, new_slope - slope
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y, 1 / (s @ y))]
        x, value, slope = moved, new, new_slope
        now = watch(new, new_watched)
        if now < best_watched - 1e-6:
            best, best_watched, bad = x, now, 0
        else:
            bad += 1
            if bad >= patience:
                break
    return best


def fit_models(training: DataFrame, max_iter: int = MAX_ITER, patience: int = PATIENCE, seed: int = 42) -> IncidentModels:
    """M7 + M8: both heads fitted together on all rows of role 'fit' of :func:`features.validation_split` output (all rows
    without roles), early-stopped on the type loss of those of role 'validation'; test rows only enter the scaler, the
    labels and the class counts, which are the whole frame's.

    Without validation rows the least training loss counts. A head of one class predicts it with probability 1.
    """
    feats = FE.select_features(training)
    found = frame_statistics(training, feats)
    layers = {"trunk": list(TRUNK), "type": TYPE_BRANCH, "severity": SEVERITY_BRANCH}
    models = IncidentModels(np.empty(0), layers, list(found["types"]), list(found["severities"]), feats, found["stats"], found["types"], found["severities"])
    network = models.network()
    tasks = fit_tasks(sum(found["types"].values()))
    blocks = dealt_blocks(written(_blocks(training, feats, found, seed), "training-blocks"), tasks).persist()  # read once an evaluation
    conf = training.sparkSession.conf
    before = conf.get(BATCH_BYTES_CONF)
    conf.set(BATCH_BYTES_CONF, BATCH_BYTES)  # else a task's blocks go to Python all at once, 64 MB at most
    try:
        models.weights = minimize(Objective(blocks, network), network.first(seed), max_iter, patience)
    finally:
        conf.set(BATCH_BYTES_CONF, before)
        blocks.unpersist()
    return models


# ---------------------------------------------------------------- M10, M11: scoring
def _labels_lit(labels: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in labels])


def top_k(prob: Column, labels: list[str], k: int = 3) -> dict[str, Column]:
    """Arg-max label and confidence, and the ``k`` most likely (label, probability) pairs.

    One order everywhere: probability descending, class index ascending.
    """
    ranked = F.array_sort(F.transform(prob, lambda p, i: F.struct((-p).alias("neg"), i.alias("idx"), p.alias("p"))))
    lab = _labels_lit(labels)
    top = F.transform(
        F.slice(ranked, 1, k),
        lambda e: F.struct(F.element_at(lab, e["idx"] + 1).alias("crim"), e["p"].alias("probabilitat")),
    )
    return {
        "prediction": F.element_at(lab, ranked[0]["idx"] + 1),
        "confidence": ranked[0]["p"],
        "top_3": top,
    }


def request_features(df: DataFrame) -> DataFrame:
    """M10 feature projection of prediction requests: premise/weapon codes are 0, time = hour * 100,
    sex encoded; the requested area does not enter the model."""
    return df.withColumns({
        "year": F.col("year"),
        "time_occ": (F.col("hour") * 100).cast("int"),
        "vict_age": F.col("age"),
        "vict_sex": F.when(F.col("sex").isNotNull(), text.encode_sex(F.col("sex"))),
        "month_num": F.col("month"),
        "premis_cd": F.lit(0.0),
        "weapon_used_cd": F.lit(0.0),
    })


def probabilities(models: IncidentModels, features: DataFrame) -> DataFrame:
    """``features`` (double columns in the model's order) with ``type_prob`` and ``severity_prob``: one inference stage."""
    network, weights, names = models.network(), models.weights, features.columns
    stats = np.array([models.stats[c] for c in models.feature_cols])

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.asarray(c, "f8") for c in batch.columns]).reshape(batch.num_rows, -1)
            found = network.predict(weights, (x - stats[:, 0]) / stats[:, 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(p), pa.list_(pa.float64())) for p in found)], names=[*names, "type_prob", "severity_prob"])

    return features.mapInArrow(infer, ", ".join(f"{c} double" for c in names) + ", type_prob array<double>, severity_prob array<double>")


def score(models: IncidentModels, requests: DataFrame) -> DataFrame:
    """M10 + M11: add prediction, confidence, top_3, severity, severity_confidence.

    ``requests`` carries lat, lon, year, month, day_of_week, hour, age, sex. Each distinct set of features is scored once,
    in one stage whose result is written and joined back, so later filters never run the network again. A request with a
    null or non-finite field gets nulls; the others aren't affected.
    """
    base = requests.columns
    names = [f"_f{i}" for i in range(len(models.feature_cols))]
    held = requests.select("*", *[F.col(c).alias(f"_b{i}") for i, c in enumerate(base)])
    asked = request_features(held).select(*[F.col(c).cast("double").alias(n) for c, n in zip(models.feature_cols, names, strict=True)], *[f"_b{i}" for i in range(len(base))])
    whole = F.lit(True)
    for n in names:
        whole = whole & F.coalesce(F.abs(n) < float("inf"), F.lit(False))
    likely, severe = top_k(F.col("type_prob"), models.type_labels), top_k(F.col("severity_prob"), models.severity_labels, 1)
    added = {**likely, "severity": severe["prediction"], "severity_confidence": severe["confidence"]}
    found = probabilities(models, asked.filter(whole).select(*names).distinct())
    scored = written(found.select(*names, *[v.alias(f"_r{i}") for i, v in enumerate(added.values())]), "scores")
    back = [F.col(f"_b{i}").alias(c) for i, c in enumerate(base)]
    # shuffled, whatever the files weigh: small ones may hold many requests or results
    done = asked.filter(whole).join(scored.hint("merge"), names).select(*back, *[F.col(f"_r{i}").alias(c) for i, c in enumerate(added)])
    rest = asked.filter(~whole).select(*back, *[F.lit(None).cast(done.schema[c].dataType).alias(c) for c in added])
    return done.unionByName(rest)


def model_scorer(models: IncidentModels):
    """Scorer protocol of :mod:`urbanlens.operators.routes` backed by the classifier."""
    def scorer(df: DataFrame) -> DataFrame:
        return score(models, df).drop("top_3")

    return scorer


# ---------------------------------------------------------------- M9: evaluation
def confusion(models: IncidentModels, test: DataFrame) -> DataFrame:
    """(target, actual, predicted, n): both heads' confusion matrices over the test rows, from one scan and aggregation."""
    feats = models.feature_cols
    names = [f"_f{i}" for i in range(len(feats))]
    x = test.select(*[F.col(c).cast("double").alias(n) for c, n in zip(feats, names, strict=True)], F.col(FE.TARGET).alias("_type"), F.col("severity").alias("_severity"))
    network, weights, types, severities = models.network(), models.weights, models.type_labels, models.severity_labels
    stats = np.array([models.stats[c] for c in feats])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([np.asarray(batch.column(n), "f8") for n in names]).reshape(batch.num_rows, -1)
            found = network.predict(weights, (rows - stats[:, 0]) / stats[:, 1])
            # ties go to the smaller index, as in top_k
            said = [pa.array([labels[i] for i in p.argmax(axis=1)], pa.string()) for p, labels in zip(found, (types, severities), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_type"), said[0], batch.column("_severity"), said[1]], names=["type", "type_said", "severity", "severity_said"])

    counted = x.mapInArrow(judge, "type string, type_said string, severity string, severity_said string").groupBy("type", "type_said", "severity", "severity_said").agg(F.count(F.lit(1)).alias("n"))
    heads = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("actual"), F.col(f"{t}_said").alias("predicted")) for t in ("type", "severity")])
    return counted.select(F.explode(heads).alias("h"), "n").groupBy("h.target", "h.actual", "h.predicted").agg(F.sum("n").alias("n"))


def accuracy(models: IncidentModels, test: DataFrame) -> DataFrame:
    """M9: accuracy of both heads on the test rows (target, accuracy, n_test); no rows without test rows."""
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    return confusion(models, test).groupBy("target").agg((right / F.sum("n")).alias("accuracy"), F.sum("n").alias("n_test"))


# ---------------------------------------------------------------- S5 persistence
def _meta(models: IncidentModels) -> dict:
    return {c: getattr(models, c) for c in ("layers", "type_labels", "severity_labels", "feature_cols", "stats", "type_counts", "severity_counts")}


def _digest(meta: dict, weights: np.ndarray) -> str:
    return sha256(json.dumps(meta, sort_keys=True).encode() + weights.astype("<f8").tobytes()).hexdigest()


def save_models(models: IncidentModels, path: str, spark: SparkSession | None = None) -> str:
    """Write a new version, named by the hash of its contents, and then point to it; returns the version.

    Versions are never rewritten, and the pointer is an appended row, so a save that fails anywhere leaves the former
    version in use.
    """
    spark = spark or SparkSession.active()
    meta = _meta(models)
    version = _digest(meta, models.weights)
    stamp = time.time_ns()
    folder = f"{version[:16]}-{stamp}"
    spark.createDataFrame([(i, float(w)) for i, w in enumerate(models.weights)], "i long, weight double").coalesce(1).write.parquet(f"{path}/versions/{folder}/weights")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/versions/{folder}/manifest")
    spark.createDataFrame([(stamp, folder, version)], "stamp long, folder string, digest string").coalesce(1).write.mode("append").parquet(f"{path}/current")
    return folder


def load_models(spark: SparkSession, path: str, version: str | None = None) -> IncidentModels:
    """The version last pointed to, or the one named; its contents must have the hash that it was saved with."""
    try:
        rows = spark.read.parquet(f"{path}/current").collect()  # a row a save
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no saved model in {path}") from e
    found = [r for r in rows if version in (None, r.folder)]
    if not found:
        raise FileNotFoundError(f"no version {version} in {path}")
    at = max(found, key=lambda r: r.stamp)
    meta = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/versions/{at.folder}/manifest").collect()))
    weights = np.array([r.weight for r in spark.read.parquet(f"{path}/versions/{at.folder}/weights").orderBy("i").collect()])
    if _digest(meta, weights) != at.digest:
        raise ValueError(f"model version {at.folder} in {path} isn't what was saved")
    meta["stats"] = {c: tuple(v) for c, v in meta["stats"].items()}
    return IncidentModels(weights=weights, **meta)
