"""End-to-end batch job: incident CSV -> curated table -> exploration tables -> classifiers.

    python -m urbanlens.jobs --input <csv path> --out <folder> [--sample N] [--no-explore]

Steps: header CSV scan (S1) -> optional seeded sample of N rows (L1) -> cleaning
(P1-P8) written as the year-partitioned curated table (S4) -> the data behind
every exploration chart (A1-A12) written as parquet tables -> training frame,
split and class weights (M1-M6) -> the two-headed classifier (M7, M8), its test
accuracy (M9) and the saved model artifacts (S5). Every step is a Spark job
over the whole input; the driver only receives the small summary.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from urbanlens.operators import dashboard as D
from urbanlens.operators import explore as E
from urbanlens.operators import features as FE
from urbanlens.operators import models as M
from urbanlens.sources import incidents as I

EXPLORATION = {
    "top_crimes": E.top_crimes,
    "monthly_counts": E.monthly_counts,
    "year_month_pivot": E.year_month_pivot,
    "top_areas": E.top_areas,
    "hour_counts": E.hour_counts,
    "age_histogram": E.age_histogram,
    "age_density": E.age_density,
    "sex_counts": E.sex_counts,
    "top_weapons": E.top_weapons,
    "area_sex_crosstab": E.area_sex_crosstab,
    "class_imbalance": E.class_imbalance,
}


def training_job(spark: SparkSession, csv_path: str, out_dir: str, sample: int | None = None,
                 explore: bool = True) -> dict:
    """Run the whole batch job; returns a small summary (row counts, accuracies, output folders)."""
    raw = I.read_incident_csv(spark, csv_path)
    if sample:
        raw = D.sample_n(raw, sample, "42")
    curated = os.path.join(out_dir, "curated")
    audit = I.curate(raw, curated)
    clean = I.load_incidents(spark, curated_path=curated)
    written = {"curated": curated}
    if explore:
        for name, fn in EXPLORATION.items():
            path = os.path.join(out_dir, "explore", name)
            fn(clean).write.mode("overwrite").parquet(path)
            written[name] = path
    split = FE.validation_split(FE.stratified_split(FE.training_frame(clean)))
    split = split.persist()
    summary: dict = {"audit": audit, "outputs": written}
    if split.filter(F.col("split") == "train").isEmpty():
        summary["models"] = None
        split.unpersist()
        return summary
    bal = os.path.join(out_dir, "explore", "severity_balance")
    E.severity_balance(split).write.mode("overwrite").parquet(bal)
    FE.class_weights(split).write.mode("overwrite").parquet(os.path.join(out_dir, "class_weights"))
    models = M.fit_models(split)
    acc = {r["target"]: r["accuracy"] for r in M.accuracy(models, split.filter(F.col("split") == "test")).collect()}
    M.save_models(models, os.path.join(out_dir, "models"), spark)
    split.unpersist()
    summary["models"] = {"path": os.path.join(out_dir, "models"), "accuracy": acc,
                         "type_labels": models.type_labels, "severity_labels": models.severity_labels}
    return summary


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--input", required=True, help="incident CSV file or folder (header row)")
    p.add_argument("--out", required=True, help="output folder (curated table, exploration tables, models)")
    p.add_argument("--sample", type=int, default=None, help="use a seeded sample of this many rows")
    p.add_argument("--no-explore", action="store_true", help="skip the exploration tables")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("urbanlens-training").getOrCreate()
    print(json.dumps(training_job(spark, a.input, a.out, a.sample, not a.no_explore), default=str))


if __name__ == "__main__":
    main()
