"""Counts, evaluation against ground truth, leak tests and review tables: relational throughout."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..types import ENTITY


def class_of(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for t, (c, _) in ENTITY.items() for x in (t, c)))
    return F.try_element_at(table, kind)


def counts_by_class(spans: DataFrame) -> DataFrame:
    """class, type, n, n_unique, over every type and, with a null type, every class; the last row is of all."""
    rows = spans.withColumn("class", class_of(F.col("type"))).withColumn("value", S.eval_norm(F.col("text"), F.col("type")))
    return rows.rollup("class", "type").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_unique"))


def class_series(spans: DataFrame) -> DataFrame:
    """class, n, place: detections of each class, the commonest first."""
    counted = spans.withColumn("class", class_of(F.col("type"))).groupBy("class").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "class")))  # a handful of classes


def unique_detections(spans: DataFrame, scope: str = "doc_id") -> DataFrame:
    rows = spans.withColumn("class", class_of(F.col("type"))).withColumn("value", S.eval_norm(F.col("text"), F.col("type")))
    first = F.row_number().over(Window.partitionBy(scope, "class", "value").orderBy("start", "end"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def score(found: DataFrame, truth: DataFrame, lenient: bool = False) -> DataFrame:
    """Per class and for all (class null): tp, fp, fn, precision, recall, f1, csi.

    found (id, class, value), truth (id, class, value, detect), values in normal form. Strict is equality; lenient is containment
    with half the length at least, addresses also by covering 0.8 of the truth's words with pieces that have half of theirs in it.
    A find counts as false only if it matches no truth even leniently.
    """
    f, t = found.select(F.col("id").alias("f_id"), "class", F.col("value").alias("f")), truth.select(F.col("id").alias("t_id"), "class", F.col("value").alias("t"), "detect")
    exact = f.join(t, (f["class"] == t["class"]) & (F.col("f") == F.col("t"))).select("f_id", "t_id")
    rest = f.join(exact, "f_id", "left_anti")  # only what is not found again as it is can be used loosely
    loose = _contained(f if lenient else rest, t)
    taken, told = _parts(f if lenient else rest, t)
    hit = exact.select("t_id").distinct()
    if lenient:
        covered = told.groupBy("t_id").agg((F.countDistinct("w") / F.max("size")).alias("c")).where("c >= 0.8").select("t_id")
        hit = hit.union(loose.select("t_id")).union(covered).distinct()
    used = exact.select("f_id").union(loose.select("f_id")).union(taken).distinct()
    must = t.where("detect")
    tp = must.join(hit, "t_id", "left_semi").select("class", F.lit("tp").alias("k"))
    fn = must.join(hit, "t_id", "left_anti").select("class", F.lit("fn").alias("k"))
    fp = f.join(used, "f_id", "left_anti").select("class", F.lit("fp").alias("k"))
    n = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, 1).otherwise(0)), F.lit(0)).cast("long").alias(k)
    return rates(tp.union(fn).union(fp).rollup("class").agg(n("tp"), n("fp"), n("fn")))


def _bound(value: Column, use) -> Column:
    """use(value), where value is evaluated once, however often use has it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _windows(c: Column, p: Column) -> tuple[Column, Column]:
    """Hashes of the stretches of c of k characters, and how many of them p characters hold; k: p up to 8, then half of p, but 8 at least."""
    k = F.when(p <= 8, p).otherwise(F.greatest(F.lit(8), F.floor(p / 2))).cast("int")
    n = F.length(c) - k + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(c.substr(i, k)))), p - k + 1


def _power(c: Column) -> Column:
    """The largest power of two that is no more than c's length."""
    return F.pow(F.lit(2), F.length(F.bin(F.length(c))) - 1).cast("int")


def _mark(c: Column) -> Column:
    """(p, g): the least hash among the stretches of the first p characters, p by the value's length."""
    windows, w = _windows(c, _power(c))
    return F.when(F.length(c) > 0, F.struct(_power(c).alias("p"), F.array_min(F.slice(windows, F.lit(1), w)).alias("g")))


def _marks(c: Column) -> Column:
    """All (p, g) that a value of half this length at least has as its mark, if it stands in c."""

    def of(p: Column) -> Column:
        windows, w = _windows(c, p)
        least = _bound(windows, lambda h: F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - w + 1, F.lit(1))), lambda i: F.array_min(F.slice(h, i, w))))
        return F.transform(F.array_distinct(least), lambda g: F.struct(p.alias("p"), g.alias("g")))

    p = _power(c)
    return F.when(F.length(c) > 1, F.concat(of(p), of((p / 2).cast("int")))).when(F.length(c) == 1, of(p))


def _contained(f: DataFrame, t: DataFrame) -> DataFrame:
    """(f_id, t_id) where one holds the other and is at most twice as long. They meet on the held value's mark, which is among its
    holder's marks: as long as a quarter of the held value at least, and a handful a value. Neither side is ever sent whole to every
    task: the exploded one is far larger than what Spark takes it for."""
    like = lambda a, b: F.contains(F.col(b), F.col(a)) & (F.length(a) >= 0.5 * F.length(b))
    one = lambda df, c: df.withColumn("m", _mark(F.col(c))).withColumn("p", F.col("m.p")).withColumn("g", F.col("m.g")).drop("m")
    every = lambda df, c: df.withColumn("m", F.explode(_marks(F.col(c)))).withColumn("p", F.col("m.p")).withColumn("g", F.col("m.g")).drop("m")
    inner = one(f, "f").hint("merge").join(every(t, "t").hint("merge"), ["class", "p", "g"]).where(like("f", "t"))
    outer = every(f, "f").hint("merge").join(one(t, "t").hint("merge"), ["class", "p", "g"]).where(like("t", "f"))
    return inner.select("f_id", "t_id").union(outer.select("f_id", "t_id")).distinct()


#: Known words of a find up to which its halves are listed; what has more meets each truth by itself.
FEW_WORDS = 8


def _parts(f: DataFrame, t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of addresses: the finds (f_id) that have half of their words in a truth, and the truths' words (t_id, w, size) that such finds have.

    What a find shares with a truth is the union of its halves that the truth has, so equal halves of many finds are one, and a truth meets
    each once, on its rarest word; words that all addresses have make no pairs of finds and truths."""
    truth = t.where("class = 'Addresses'").select("t_id", S.tokens(F.col("t")).alias("tt"))
    words = truth.select("t_id", "tt", F.explode("tt").alias("w"))
    rare = words.groupBy("w").agg(F.count("*").alias("n"))
    finds = f.where("class = 'Addresses'").select("f_id", F.array_sort(S.tokens(F.col("f"))).alias("ft"))
    values = finds.select("ft").distinct()
    known = values.select("ft", F.explode("ft").alias("w")).hint("merge").join(rare, "w").groupBy("ft").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("ws"))
    known = known.withColumn("h", F.ceil(F.size("ft") / 2).cast("int")).where("size(ws) >= h")
    none = F.array(F.array().cast("array<string>"))
    grown = F.aggregate("ws", none, lambda acc, w: F.concat(acc, F.transform(F.filter(acc, lambda s: F.size(s) < F.col("h")), lambda s: F.concat(s, F.array(w)))))
    halves = known.where(F.size("ws") <= FEW_WORDS).select("ft", F.explode(F.filter(grown, lambda s: F.size(s) == F.col("h"))).alias("s"))
    met = halves.select("s").distinct().withColumn("w", F.col("s")[0]).hint("merge").join(words.hint("merge"), "w").where(F.size(F.array_except("s", "tt")) == 0)
    some = F.slice("ws", F.lit(1), F.size("ws") - F.col("h") + 1)
    long = known.where(F.size("ws") > FEW_WORDS).select("ft", "h", F.explode(some).alias("w")).hint("merge").join(words.hint("merge"), "w")
    long = long.withColumn("s", F.array_intersect("ft", "tt")).where("size(s) >= h")
    told = met.select("t_id", "tt", "s").union(long.select("t_id", "tt", "s")).select("t_id", F.explode("s").alias("w"), F.size("tt").alias("size"))
    fits = halves.join(met.select("s").distinct().hint("merge"), "s", "left_semi").select("ft").union(long.select("ft")).distinct()
    return finds.join(fits.hint("merge"), "ft", "left_semi").select("f_id"), told


def _pieces(f: DataFrame, t: DataFrame) -> DataFrame:
    """(f_id, t_id, t, shared) of addresses: finds that have half of their words in a truth. They meet on one of half a find's words."""
    words = lambda c: F.array_sort(F.transform(S.tokens(F.col(c)), lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w"))))
    some = F.slice(words("f"), F.lit(1), F.floor(F.size(words("f")) / 2).cast("int") + 1)
    a = f.where("class = 'Addresses'").withColumn("w", F.explode(F.transform(some, lambda x: x["w"])))
    b = t.where("class = 'Addresses'").withColumn("w", F.explode(S.tokens(F.col("t"))))
    pairs = a.join(b.drop("class"), "w").select("f_id", "t_id", "f", "t").distinct()
    shared = F.array_intersect(S.tokens(F.col("f")), S.tokens(F.col("t")))
    return pairs.withColumn("shared", shared).where(F.size("shared") >= 0.5 * F.size(S.tokens(F.col("f")))).select("f_id", "t_id", "t", "shared")


def rates(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 and csi from tp, fp, fn; an empty denominator gives 1, for f1 0. f1 is of the rounded rates."""
    share = lambda a, b, other: F.when(b == 0, F.lit(other)).otherwise(F.round(a / b, 4))
    out = counts.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn"), 1.0))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", share(2 * p * r, p + r, 0.0)).withColumn("csi", share(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"), 1.0))


def present(kind: Column, value: Column, text: Column) -> Column:
    """Whether a value is in a text: identifiers by their bare characters, addresses by 0.6 of their words, others as a phrase."""
    words = S.tokens(value)
    phrase = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    ids = [t for t, (_, alnum) in ENTITY.items() if alnum]
    return F.when(kind.isin(*ids), F.contains(S.alnum_key(text), S.alnum_key(value))).when(kind == "ADDRESS", F.size(F.array_intersect(words, S.tokens(text))) >= 0.6 * F.size(words)).otherwise(F.contains(flat, phrase))


def leaks(values: DataFrame, before: DataFrame, after: DataFrame, scope: str = "doc_id") -> DataFrame:
    """Per class: how many values (scope, type, original) were in the scope's text before, and how many still are after."""
    rows = values.join(before.select(scope, F.col("text").alias("_b")), scope).join(after.select(scope, F.col("text").alias("_a")), scope)
    was = present(F.col("type"), F.col("original"), F.col("_b"))
    rows = rows.groupBy(scope, "type", "original").agg(F.max(was).alias("was"), F.max(present(F.col("type"), F.col("original"), F.col("_a"))).alias("is_"))
    measured = rows.where("was").withColumn("class", class_of(F.col("type")))
    return measured.rollup("class").agg(F.count("*").alias("measurable"), F.sum(F.col("is_").cast("long")).alias("leaked"))


def partial_leaks(values: DataFrame, after: DataFrame, common: list[str], scope: str = "doc_id") -> DataFrame:
    """Distinctive words of names and organisations (four letters and more, not common) that the rewritten text still has."""
    words = values.where("type in ('PERSON', 'ORG')").select(scope, F.explode(F.regexp_extract_all(F.lower("original"), F.lit(r"([\p{L}]{4,})"), 1)).alias("word")).distinct()
    words = words.where(~F.col("word").isin(*common or [""]))
    kept = after.select(scope, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]{4,})"), 1))).alias("word"))
    return words.join(kept, [scope, "word"], "left_semi")


#: Values that are looked for in one pass over the texts; what a task is sent stays under some MB.
AT_ONCE = 10_000


def _found(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = set(shared.value)
        for batch in batches:
            here = {v for t in batch.column(0).to_pylist() if t for v in left if v in t}
            left -= here
            if here:
                yield pa.RecordBatch.from_arrays([pa.array(sorted(here), pa.string())], ["value"])

    return run


def lost(negatives: DataFrame, after: DataFrame) -> DataFrame:
    """Texts that should have survived (value) and are in no row of after any more. Each pass over the texts carries AT_ONCE values."""
    spark, values = after.sparkSession, negatives.select("value").where("value is not null").distinct()
    parts = -(-values.count() // AT_ONCE)
    found = values.where("false")
    for k in range(parts):
        own = [r.value for r in values.where(F.pmod(F.xxhash64("value"), F.lit(parts)) == k).collect()]
        found = found.union(after.select("text").mapInArrow(_found(spark.sparkContext.broadcast(own)), "value string"))
    return negatives.join(found.distinct(), "value", "left_anti")


def inconsistent(mapping: DataFrame) -> DataFrame:
    """(type, value, n): normal forms with several pseudonyms."""
    rows = mapping.withColumn("value", S.eval_norm(F.col("original"), F.col("type")))
    return rows.groupBy("type", "value").agg(F.countDistinct(F.lower("pseudonym")).alias("n")).where("n > 1")


def in_context(detected: DataFrame, *keys: str, text: str = "text", spans: str = "spans", around: int = 60) -> DataFrame:
    """Rows of spans (keys, start, end, type, text, source) with the text around each, cut where it is detected."""
    cut = lambda s: F.col(text).substr(F.greatest(s["start"] - around, F.lit(0)) + 1, F.least(s["start"], F.lit(around)) + F.length(s["text"]) + around)
    rows = F.transform(F.col(spans), lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "type", "text", "source")), cut(s).alias("context")))
    return detected.select(*keys, F.explode(rows).alias("_s")).select(*keys, "_s.*")


def proposals(rows: DataFrame, scope: str = "doc_id", most_contexts: int = 3) -> DataFrame:
    """For review, from rows of in_context: type, value, rules, occurrences, contexts of each distinct value; the contexts are its first few."""
    rows = rows.withColumn("value", F.lower("text"))
    place = F.row_number().over(Window.partitionBy("type", "value").orderBy(scope, "start"))
    first = rows.select("type", "value", scope, "start", "context").withColumn("_n", place).where(F.col("_n") <= most_contexts)  # a task keeps the first few of each value
    first = first.groupBy("type", "value").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "context"))), lambda x: x["context"]), " | ").alias("contexts"))
    counted = rows.groupBy("type", "value").agg(F.array_join(F.array_sort(F.collect_set("source")), ";").alias("rules"), F.count("*").alias("occurrences"))
    return counted.join(first, ["type", "value"])


def ground_truth(review: DataFrame) -> DataFrame:
    """(value, type, negative) from reviewed rows (type, value, label): TP and FN stand, TYPE:x changes the type, FP is a negative."""
    label = F.upper(F.trim("label"))
    return review.where(label.rlike("^(TP|FN|FP|TYPE:.+)$")).select("value", F.when(label.startswith("TYPE:"), F.trim(F.substring(label, 6, 100))).otherwise(F.col("type")).alias("type"), (label == "FP").alias("negative"))


def structure_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metrics (doc_id, metric, n) that differ; a metric that one side lacks counts as 0."""
    a, b = before.withColumnRenamed("n", "n_before"), after.withColumnRenamed("n", "n_after")
    both = a.join(b, ["doc_id", "metric"], "full").fillna(0, ["n_before", "n_after"])
    return both.where("n_before <> n_after")
