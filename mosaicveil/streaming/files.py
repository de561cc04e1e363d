"""New texts as they arrive: each micro-batch is detected, added to a dictionary table and rewritten with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import dictionary
from ..operators.names import free_text_spans
from ..operators.resolve import detect, span_rows
from ..types import Config


def redact_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, config: Config = Config()) -> StreamingQuery:
    """Parquet files (doc_id, text, ...) arriving in source are written, rewritten, to out. A document's dictionary is its own, and
    pseudonyms follow from the salt and the document, so a batch that is run again writes the same rows to its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        spans = span_rows(detect(df.select("doc_id", "text"), config=config, extra=(free_text_spans(),)), "doc_id")
        mapping = dictionary.build(spans, config.salt)
        dictionary.rewrite(df, mapping).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
