"""Filtering, allowlists and greedy resolution of overlapping spans, row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..types import SPANS, Config
from .patterns import all_pattern_spans


def allowed(span: Column, config: Config) -> Column:
    """Whether a span is on an allowlist: names whole or as an ending, hosts whole or under a parent."""
    name, host = S.norm(span["text"]), S.host_of(span["text"])
    entity, domain = F.lit(False), F.lit(False)
    for a in config.allow:
        low = " ".join(a.lower().split())
        entity |= (name == low) | name.endswith(" " + low)
    for d in config.allow_domains:
        domain |= (host == d.lower()) | host.endswith("." + d.lower())
    return F.when(span["type"].isin("ORG", "PERSON"), entity).when(span["type"].isin("URL", "EMAIL"), domain).otherwise(False)


def admissible(spans: Column, config: Config) -> Column:
    return F.filter(spans, lambda s: (s["score"] >= config.min_score) & ~s["type"].isin(*config.disabled or ("",)) & ~allowed(s, config))


def greedy(spans: Column) -> Column:
    """Spans that stay, by start: tier, score, length, start, then order of generation decide who goes first."""
    keyed = F.transform(
        spans,
        lambda s, i: F.struct(
            F.when(s["score"] >= 0.9, 0).when(s["type"] == "ADDRESS", 1).otherwise(2).alias("tier"),
            (-s["score"]).alias("by_score"),
            (s["start"] - s["end"]).alias("by_length"),
            s["start"].alias("by_start"),
            i.alias("made"),
            s.alias("span"),
        ),
    )
    ordered = F.transform(F.array_sort(keyed), lambda k: k["span"])
    kept = F.aggregate(ordered, F.array().cast(SPANS), lambda acc, s: F.when(F.exists(acc, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), acc).otherwise(F.concat(acc, F.array(s)).cast(SPANS)))
    return F.array_sort(kept)


def detect(df: DataFrame, text: str = "text", config: Config = Config(), extra: tuple[Callable[[Column], Column], ...] = (), out: str = "spans", resolve: bool = True, id_context: Column | bool = False) -> DataFrame:
    """Adds the spans of each row's text as column out, which replaces one of that name; other columns stay, whatever their names.

    extra: functions from the text column to a span array, such as names.free_text_spans. id_context: a column or a value that tells
    whether the text comes from an identity document, where dates of birth need no cue."""
    raw = F.concat(all_pattern_spans(F.col(text), config, id_context=id_context), *(f(F.col(text)) for f in extra))
    found = df.withColumn(out, F.coalesce(raw, F.array().cast(SPANS)))
    found = found.withColumn(out, admissible(F.col(out), config))
    return found.withColumn(out, greedy(F.col(out))) if resolve else found


def span_rows(df: DataFrame, *keys: str, spans: str = "spans") -> DataFrame:
    return df.select(*keys, F.posexplode(spans).alias("seq", "_s")).select(*keys, "seq", "_s.*")
