"""python -m mosaicveil texts IN.parquet OUT | python -m mosaicveil packages FOLDER OUT"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.redact import redact_packages, redact_texts
from .sources import ooxml, tables
from .types import Config


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="mosaicveil")
    p.add_argument("kind", choices=("texts", "packages"))
    p.add_argument("source")
    p.add_argument("out")
    p.add_argument("--salt", required=True, help="secret that keys the pseudonyms")
    p.add_argument("--as-of", default=Config.as_of)
    p.add_argument("--min-score", type=float, default=Config.min_score)
    p.add_argument("--mapping", help="where to write the originals and their pseudonyms")
    p.add_argument("--report")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("mosaicveil").getOrCreate()
    config = Config(as_of=a.as_of, min_score=a.min_score, salt=a.salt)
    if a.kind == "texts":
        done = redact_texts(spark.read.parquet(a.source), config)
        done.texts.write.mode("overwrite").parquet(a.out)
    else:
        done = redact_packages(ooxml.read_packages(spark, a.source), config)
        ooxml.save(done.texts, a.out)
    if a.mapping:
        tables.write_mapping(done.mapping, a.mapping)
    if a.report:
        tables.write_report(done.report, a.report)
    for row in done.report.collect():
        print(row.asDict())


if __name__ == "__main__":
    main()
