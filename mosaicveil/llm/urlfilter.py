"""URL verdicts: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The list may be of any length. Each listed URL sets one bit in each of the eight 32-bit words of one block; blocks are OR-ed by a
partially aggregated group-by. Their number follows the list's count, some 16 URLs a block, up to BLOCKS (4 MB of words), a proven
bound, so the block table is broadcast; a longer list fills the blocks and sends more URLs on to the join, which stays exact.
URLs whose bits are all set are possible hits and go on to a hash join with the list itself, which removes the false ones.

host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end;
both empty for a null URL or one without ``://``. A rule (verdict, domain, path start) fits a URL whose host is its domain or a
subdomain and whose path starts with its own; of several the longest decides, at equal length the one listed first.
The canonical form drops scheme, ``www.`` or ``m.``, a default port, query, fragment, and a closing ``/``, ``.html`` or ``index.html``.

Repeated rows are judged one by one; null ids stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS, WORDS, PER_BLOCK = 1 << 17, 8, 16
#: (verdict, domain, start of the path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def split(df: DataFrame) -> DataFrame:
    """Adds host and path to rows with a column url."""
    rest = df.withColumn("_rest", _after_scheme(F.col("url")))
    raw = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    rest = rest.withColumn("_host", raw)
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0)
    low = F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rest.withColumn("path", path).withColumn("host", low).drop("_rest", "_host")


def canonical(host: Column, path: Column) -> Column:
    """One spelling for URLs of the same page; null without a host."""
    h = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    p = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", ""), r"(\.html?|/+)$", "")
    return F.when(host != "", F.concat(h, p))


def _fits(domain: str, start: str) -> Column:
    return ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(start)


def ruled(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda what: functools.reduce(lambda w, r: w.when(_fits(r[1], r[2]), F.lit(what(r))), order, F) if order else F.lit(None).cast("string")
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def blocks_for(count: int) -> int:
    """Number of blocks, a power of two, for so many keys."""
    return min(BLOCKS, 1 << max(0, (count // PER_BLOCK).bit_length()))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, w: int) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.pmod(F.xxhash64(key, F.lit(w + 1)), F.lit(32)).cast("int"))


def bloom(listed: DataFrame, key: str = "canonical", blocks: int = BLOCKS) -> DataFrame:
    """At most so many rows: block and its eight words."""
    words = [F.bit_or(_bit(F.col(key), w)).alias(f"w{w}") for w in range(WORDS)]
    return listed.where(F.col(key).isNotNull()).groupBy(_block(F.col(key), blocks).alias("_block")).agg(*words)


def probe(urls: DataFrame, table: DataFrame, key: str = "canonical", blocks: int = BLOCKS) -> DataFrame:
    """Adds possible: false only for keys that are surely not listed."""
    hit = functools.reduce(lambda a, b: a & b, [F.col(f"w{w}").bitwiseAND(_bit(F.col(key), w)) == _bit(F.col(key), w) for w in range(WORDS)])
    joined = urls.withColumn("_block", _block(F.col(key), blocks)).join(F.broadcast(table), "_block", "left")
    return joined.withColumn("possible", F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull()).drop("_block", *(f"w{w}" for w in range(WORDS)))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for each row of pages (page_id, url); listed holds canonical URLs to block."""
    listed = listed.select(F.col("canonical").alias("_listed")).where("_listed is not null").distinct()
    rule, verdict = ruled(rules)
    rows = split(pages.select("page_id", "url")).withColumn("canonical", canonical(F.col("host"), F.col("path")))
    blocks = blocks_for(listed.count())
    rows = probe(rows.withColumn("rule", rule).withColumn("_ruled", verdict), bloom(listed, "_listed", blocks), blocks=blocks)
    sure = rows.where("not possible").withColumn("listed", F.lit(False))
    asked = rows.where("possible").join(listed, F.col("canonical") == F.col("_listed"), "left").withColumn("listed", F.col("_listed").isNotNull()).drop("_listed")
    out = sure.unionByName(asked)
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def crawled_twice(pages: DataFrame) -> DataFrame:
    """The list of the registered query: canonical URLs that several rows of pages have."""
    rows = split(pages.select("page_id", "url"))
    rows = rows.select(canonical(F.col("host"), F.col("path")).alias("canonical")).where("canonical is not null")
    return rows.groupBy("canonical").count().where("count > 1").select("canonical")
