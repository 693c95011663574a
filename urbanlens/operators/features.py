"""Training data jobs: training frame (M1, P17, P18), label indexing (M2), scaling (M3),
hash split (M4, M5) and balanced class weights (M6)."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanlens.functions import text
from urbanlens.operators.clean import complete_cases
from urbanlens.operators.explore import topn_semi_join

# Feature order is part of the model contract (it is saved with the model).
FEATURES = ["year", "lat", "lon", "time_occ", "vict_age", "vict_sex", "month_num", "premis_cd", "weapon_used_cd", "day_of_week"]
TARGET = "crm_cd_desc"
N_TOP_CLASSES = 10
TEST_PCT = 20
VALIDATION_PCT = 20


def select_features(df: DataFrame) -> list[str]:
    """The feature columns present, in the fixed order."""
    return [c for c in FEATURES if c in df.columns]


def training_frame(clean: DataFrame, n_top: int = N_TOP_CLASSES) -> DataFrame:
    """M1: complete cases of features + target, sex encoded, the ``n_top`` most frequent types only,
    and the severity label."""
    feats = select_features(clean)
    work = complete_cases(clean.select("dr_no", *feats, TARGET), feats + [TARGET])
    if "vict_sex" in feats:
        work = work.withColumn("vict_sex", text.encode_sex(F.col("vict_sex")))
    work = topn_semi_join(work, TARGET, n_top)
    return work.withColumn("severity", text.classify_severity(F.col(TARGET)))


def fit_label_indexers(training: DataFrame) -> tuple[StringIndexerModel, StringIndexerModel]:
    """M2: sorted distinct labels -> 0..k-1 for the type and the severity."""
    t = StringIndexer(inputCol=TARGET, outputCol="type_label", stringOrderType="alphabetAsc").fit(training)
    s = StringIndexer(inputCol="severity", outputCol="severity_label", stringOrderType="alphabetAsc").fit(training)
    return t, s


def stats_and_indexers(training: DataFrame, feats: list[str] | None = None):
    """Scaler statistics (M3) and both label indexers (M2) from ONE aggregation over the training rows.

    The label sets are bounded by the kept classes (at most ``N_TOP_CLASSES`` types, two severities).
    """
    feats = feats or select_features(training)
    row = training.agg(
        *[F.avg(c).alias(f"m_{c}") for c in feats], *[F.stddev_pop(c).alias(f"s_{c}") for c in feats],
        F.collect_set(TARGET).alias("types"), F.collect_set("severity").alias("sevs"),
    ).first()
    stats = {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"]) if row[f"s_{c}"] else 1.0) for c in feats}
    t = StringIndexerModel.from_labels(sorted(row["types"]), inputCol=TARGET, outputCol="type_label")
    s = StringIndexerModel.from_labels(sorted(row["sevs"]), inputCol="severity", outputCol="severity_label")
    return stats, t, s


def label_index(training: DataFrame) -> DataFrame:
    t, s = fit_label_indexers(training)
    return s.transform(t.transform(training))


def scaler_stats(training: DataFrame, feats: list[str] | None = None) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of every feature in one aggregation (zero std -> 1)."""
    feats = feats or select_features(training)
    row = training.agg(
        *[F.avg(c).alias(f"m_{c}") for c in feats], *[F.stddev_pop(c).alias(f"s_{c}") for c in feats]
    ).first()
    out = {}
    for c in feats:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        out[c] = (float(m or 0.0), float(s) if s else 1.0)
    return out


def _dlit(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def scaling_sql(stats: dict[str, tuple[float, float]], prefix: str = "z_") -> str:
    """M3 as a SQL statement (used as a persisted SQLTransformer stage): (x - mean) / std."""
    cols = ", ".join(f"(CAST({c} AS DOUBLE) - {_dlit(m)}) / {_dlit(s)} AS {prefix}{c}" for c, (m, s) in stats.items())
    return f"SELECT *, {cols} FROM __THIS__"


def scaled_features(training: DataFrame, stats: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """M3: standardized features (population std, fitted on the whole frame before the split)."""
    stats = stats or scaler_stats(training)
    return training.select(
        "dr_no", *[((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(f"z_{c}") for c, (m, s) in stats.items()]
    )


def _bucket(key: F.Column, salt: str = "") -> F.Column:
    h = F.md5(F.concat(key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % 100


def stratified_split(training: DataFrame, test_pct: int = TEST_PCT) -> DataFrame:
    """M4: deterministic 80/20 split by a hash of the record key.

    The hash is independent of the type, so every type keeps its share in
    expectation (about 20 % of each type in the test part) - no shuffle, no
    per-type window over a possibly huge type.
    """
    return training.withColumn("split", F.when(_bucket(F.col("dr_no")) < test_pct, "test").otherwise("train"))


SPLIT_BUCKET_BITS = 20


def _hash60(key: F.Column) -> F.Column:
    """60 uniform bits of the md5 of the key (non-negative bigint); rows without a key come after all others."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("bigint"), F.lit(1 << 60))


def stratified_split_exact(training: DataFrame, test_pct: int = TEST_PCT, label: str = TARGET) -> DataFrame:
    """M4, exact variant: each class puts round(test_pct % of its rows) into the test part - the
    rows with the smallest key hash - so class shares are exact, not just expected.

    The k-th smallest hash per class is found without a window over a whole class: a histogram of 2^20 hash buckets per
    class (one aggregation; the per-class cumulative sums run over one row a bucket) locates the bucket holding the
    boundary. Within it a second histogram, by exact (hash, key), finds the key at the boundary; keys before it are in
    the test part, and of the rows that share that key as many as are still due. Every other row is decided by comparison.

    Rows without a key come last in their class and are told apart like rows of one repeated key: by their position among
    them, which is arbitrary but doesn't change how many are taken. A null class is a class.
    """
    shift = 60 - SPLIT_BUCKET_BITS
    df = training.withColumn("_h", _hash60(F.col("dr_no"))).withColumn("_b", F.shiftright("_h", shift)).withColumn("_class", F.struct(F.col(label)))
    counts = df.groupBy("_class").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_k", F.floor(F.col("_n") * F.lit(test_pct / 100.0) + F.lit(0.5)).cast("bigint")
    )

    def boundary(rows: DataFrame, due: DataFrame, by: list[str]) -> DataFrame:
        """Of each class the first value of ``by`` at which as many rows as are ``due`` have come, and how many it owes."""
        hist = rows.groupBy("_class", *by).agg(F.count(F.lit(1)).alias("_c"))
        w = Window.partitionBy("_class").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("_cum", F.sum("_c").over(w)).join(due, "_class")
        at = hist.filter((F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_c") < F.col("_k")))
        return at.select("_class", *[F.col(c).alias(f"{c}_at") for c in by], (F.col("_k") - (F.col("_cum") - F.col("_c"))).alias("_k"), "_c")

    first = boundary(df, counts.select("_class", "_k"), ["_b"]).drop("_c")
    edge = df.join(first.select("_class", F.col("_b_at").alias("_b")), ["_class", "_b"], "left_semi")
    second = boundary(edge, first.select("_class", "_k"), ["_h", "dr_no"]).withColumnsRenamed({"_k": "_owed", "_c": "_of"})
    classes = counts.select("_class").join(first.select("_class", "_b_at"), "_class", "left").join(second, "_class", "left")  # one row a class
    tagged = df.join(classes, "_class", "left")
    before = (F.col("_b") < F.col("_b_at")) | ((F.col("_b") == F.col("_b_at")) & ((F.col("_h") < F.col("_h_at")) | ((F.col("_h") == F.col("_h_at")) & (F.col("dr_no") < F.col("dr_no_at")))))
    at = (F.col("_h") == F.col("_h_at")) & F.col("dr_no").eqNullSafe(F.col("dr_no_at"))
    # rows of the key at the boundary: all of them where all are owed, else ranked among themselves
    shared = F.coalesce(at & (F.col("_owed") < F.col("_of")), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("_class").orderBy("_h"))
    tied = tagged.filter(shared).withColumn("_in", rank <= F.col("_owed"))
    rest = tagged.filter(~shared).withColumn("_in", F.coalesce(before, F.lit(False)) | F.coalesce(at, F.lit(False)))
    out = tied.unionByName(rest)
    return out.withColumn("split", F.when(F.col("_in"), "test").otherwise("train")).drop("_h", "_b", "_class", "_b_at", "_h_at", "dr_no_at", "_owed", "_of", "_in")


def validation_split(split: DataFrame, pct: int = VALIDATION_PCT) -> DataFrame:
    """M5: a further hash share of the training rows held out for validation."""
    role = (
        F.when(F.col("split") == "test", "test")
        .when(_bucket(F.col("dr_no"), ":val") < pct, "validation")
        .otherwise("fit")
    )
    return split.withColumn("role", role)


def class_weights(split: DataFrame) -> DataFrame:
    """M6: balanced weights n / (k * n_c) over the training part (at most ``N_TOP_CLASSES`` rows)."""
    tr = split.filter(F.col("split") == "train").groupBy(TARGET).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    n, k = F.sum("n_c").over(w), F.count(F.lit(1)).over(w)
    return tr.select(TARGET, "n_c", F.round(n / (k * F.col("n_c")), 6).alias("weight"))
