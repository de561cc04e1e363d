"""Mappings, reports, ground truth and review tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def mapping_rows(mapping: DataFrame) -> DataFrame:
    """type, original, pseudonym: each original once, sorted."""
    return mapping.groupBy("type", "original").agg(F.min("pseudonym").alias("pseudonym")).orderBy("type", "original")


def write_mapping(mapping: DataFrame, path: str) -> None:
    """Sorted JSON lines of type, original and pseudonym. It undoes the pseudonyms: keep it apart from the texts."""
    mapping_rows(mapping).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, path: str) -> str:
    """Rates by class (audit.score) as JSON; returns them as a Markdown table, the row of all classes last."""
    metrics.write.mode("overwrite").json(path)
    rows = sorted(metrics.collect(), key=lambda r: (r["class"] is None, r["class"] or ""))
    names = ["class", "tp", "fp", "fn", "precision", "recall", "f1", "csi"]
    lines = ["| " + " | ".join(names) + " |", "|" + "-|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join("all" if r[n] is None else str(r[n]) for n in names) + " |" for r in rows])


def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, negatives) of one JSON document."""
    doc = spark.read.schema("entities array<struct<value:string,type:string,where:array<string>,detect:boolean,note:string>>, negatives array<string>").option("multiLine", True).json(path)
    entities = doc.select(F.posexplode("entities").alias("id", "e")).select("id", "e.*")
    return entities, doc.select(F.explode("negatives").alias("value"))


def write_review(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"')


def read_review(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, escape='"', multiLine=True)
