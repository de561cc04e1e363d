"""Near-duplicate classes by one-permutation hashing.

A text's words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, with
A-Z lower-cased; its set holds its distinct five-word shingles (a shorter text is one shingle; a text without words, or a null
one, has an empty set and is linked with nothing). One pass over the texts gives each document

* the size of its set and a 128-bit digest of it (equal sets form one class, which the smallest id stands for),
* a one-permutation signature: 128 bins of the hash space, the minimum of each; an empty bin copies the first filled bin of a
  universal probe sequence (optimal densification),
* 32 bands of 4 bins: two sets of similarity 0.75 miss each other in all bands with probability 5e-6.

Classes of a bucket meet its smallest class only, a star, so a bucket of n costs n - 1 candidates. Only buckets of two classes and
more are written and only they come up again. Where the links leave several components in a bucket, what lies outside its largest one
forms a second star, around a member of the largest that a hash draws for each bucket: outliers of a large group meet as many different
members as they share buckets. What then still lies outside is compared with all other components of its bucket, in one grouped pass by
parts of about BLOCK rows, sizes and bitmaps (1024 bits of shingle hashes) in memory: only pairs that pass a bound that no like pair fails
come out. So nothing that shares a bucket stays apart untested. The stars go through the same bound, and all that pass are
confirmed on the two full sets. Texts are read through a Bloom filter of the candidates' ids and travel as sets; after the first
star only those of buckets that are not settled are kept. Links are joined into components by alternating large and small stars.

Repeated rows of one id count as the same vertex, also where their texts differ (each text is compared for itself); null ids take
part under no component (component_id is null, kept is true). Ties go to the smaller id. Extra columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep, partitions
from .textops import U64, mix, shingles, slices, trim, word_bounds, word_hashes
from .urlfilter import blocks_for, bloom, probe

BINS, BANDS, BITS = 128, 32, 1024
#: Rows of one side that a grouped pass holds at a time.
BLOCK = 2048
SLICE = 1 << 20
_FEATURES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>"


def _probe(bins: int, tries: int) -> np.ndarray:
    return (mix(np.arange(bins, dtype=U64)[:, None] * U64(1 << 20) + np.arange(1, tries + 1, dtype=U64)[None, :]) % U64(bins)).astype(np.int64)


def densify(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fill the empty bins of rows that have a filled one from the first filled bin of each bin's own probe sequence."""
    bins = values.shape[1]
    out, todo, t = values.copy(), ~filled & filled.any(1)[:, None], 0
    while todo.any():
        if t % 256 == 0:
            probe = _probe(bins, t + 256)[:, t:]
        r, c = np.nonzero(todo)
        donor = probe[c, t % 256]
        ok = filled[r, donor]
        out[r[ok], c[ok]] = values[r[ok], donor[ok]]
        todo[r[ok], c[ok]] = False
        t += 1
    return out


def distinct_sets(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements of 56 bits, their rows, set sizes) of n rows (256 at most), by row, ascending, from their shingles."""
    key = np.sort((rows.astype(U64) << U64(56)) | (hashes >> U64(8)))
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    row = (key >> U64(56)).astype(np.int64)
    return key & U64((1 << 56) - 1), row, np.bincount(row, minlength=n)


def digests(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two digests of each set."""
    out = np.zeros((2, len(size)), U64)
    some = np.flatnonzero(size)
    if len(some):
        at = (np.cumsum(size) - size)[some]
        with np.errstate(over="ignore"):
            out[0, some] = np.add.reduceat(mix(low + U64(0x51ED270B)), at)
            out[1, some] = np.add.reduceat(mix(low ^ U64(0xA5A5A5A55A5A5A5A)), at)
    return out


def sketch(hashes: np.ndarray, rows: np.ndarray, n: int, bins: int = BINS, bands: int = BANDS):
    """Set sizes, two digests, band hashes and bitmaps of n rows (256 at most) from their shingles."""
    low, row, size = distinct_sets(hashes, rows, n)
    with np.errstate(over="ignore"):
        shift = U64(56 - (bins - 1).bit_length())
        slot = (row * bins) + (low >> shift).astype(np.int64)
        seen = np.zeros((n, BITS), bool)
        seen[row, (low & U64(BITS - 1)).astype(np.int64)] = True
        bits = np.packbits(seen, axis=1, bitorder="little").view(np.int64)
        first = np.r_[True, slot[1:] != slot[:-1]] if len(slot) else np.zeros(0, bool)
        values, filled = np.zeros(n * bins, U64), np.zeros(n * bins, bool)
        values[slot[first]], filled[slot[first]] = low[first] & ((U64(1) << shift) - U64(1)), True
        dense = densify(values.reshape(n, bins), filled.reshape(n, bins)).reshape(n, bands, -1)
        band = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (n, bands)).copy()
        for j in range(dense.shape[2]):
            band = mix(band * U64(31) + dense[:, :, j] + U64(j + 1))
    return size, digests(low, size), band, bits


def _shingled(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingle hashes, their rows) of slices of a text column."""
    for a, b, buf, offs in slices(column, SLICE):
        starts, ends, rows = word_bounds(buf, offs)
        yield a, b, *shingles(word_hashes(buf, starts, ends), rows, b - a)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for a, b, hashes, rows in _shingled(batch.column(1)):
            size, digest, band, bits = sketch(hashes, rows, b - a)
            lists = pa.ListArray.from_arrays(np.arange(b - a + 1, dtype=np.int32) * BANDS, pa.array(band.astype(np.int64).ravel()))
            marks = pa.ListArray.from_arrays(np.arange(b - a + 1, dtype=np.int32) * (BITS // 64), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(size.astype(np.int64)), *(pa.array(d.astype(np.int64)) for d in digest), lists, marks], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"])
        trim()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, set_a, elements) of rows (doc_id, text)."""
    for batch in batches:
        for a, b, hashes, rows in _shingled(batch.column(1)):
            low, _, size = distinct_sets(hashes, rows, b - a)
            data = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(low.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(digests(low, size)[0].astype(np.int64)), data], ["doc_id", "set_a", "elements"])
        trim()


def _digested(names: list[str], place: int):
    """Rows as they are, and the digests of their texts' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, hashes, rows in _shingled(batch.column(place)):
                low, _, size = distinct_sets(hashes, rows, b - a)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *(pa.array(d.astype(np.int64)) for d in digests(low, size))], names)

    return run


def _narrowed(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """Rows of docs but for nearly all whose id is not among the at most so many of ids: a broadcast Bloom filter of bounded size, in the JVM."""
    blocks = blocks_for(most)
    return probe(docs, bloom(ids, "doc_id", blocks), "doc_id", blocks).where("possible").drop("possible")


def confirm(pairs: DataFrame, docs: DataFrame, named: DataFrame | None = None, percent: int = 75) -> DataFrame:
    """The rows of pairs (a, b) that are linked, on the full sets; a set that many pairs ask for is joined in splits.

    a and b are ids, or where ids repeat keys of named (key, doc_id, set_a). pairs is read several times."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    ids = asked.withColumnRenamed("key", "doc_id") if named is None else asked.distinct().join(named, "key")
    sets = _narrowed(docs, ids, 2 * pairs.count()).select("doc_id", "text").mapInArrow(_sets, "doc_id long, set_a long, elements array<long>")
    if named is None:
        sets = sets.select(F.col("doc_id").alias("key"), "elements")
    else:
        sets = sets.dropDuplicates(["doc_id", "set_a"]).join(ids, ["doc_id", "set_a"]).select("key", "elements")
    sets = keep(sets, "sets")
    of = lambda c: sets.select(F.col("key").alias(c), F.col("elements").alias("of_" + c))
    both = F.size(F.array_intersect("of_a", "of_b"))
    met = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b")).alias("sizes"))
    links = keep(met.where(100 * F.col("both") >= percent * (F.col("sizes") - F.col("both"))).select("a", "b"), "links")
    forget(sets)
    return links


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is itself a u: then v is the smallest vertex that u reaches."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("top")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("top").alias("top")).where("up > 1 or up > 0 and top > 0").isEmpty()


def _forest(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every vertex of edges that is not the smallest it reaches; a kept table. Large and small stars in turn."""
    tall = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(tall):
        both = tall.unionByName(tall.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        past, tall = tall, keep(small, "edges")
        forget(past)
    out = tall.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out.kept_at = tall.kept_at
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every vertex of edges; component is the smallest id reachable."""
    found = _forest(edges, a, b)
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())


#: The words of a bitmap as columns; a test of two rows then stays small enough to be compiled.
MARKS = [f"bits{k}" for k in range(BITS // 64)]


def marks(column: str, prefix: str = "") -> list:
    """The words of a bitmap and the number of its ones, as columns."""
    ones = functools.reduce(lambda a, b: a + b, [F.bit_count(F.col(column)[k]) for k in range(len(MARKS))])
    return [*(F.col(column)[k].alias(prefix + m) for k, m in enumerate(MARKS)), ones.alias(prefix + "ones")]


def _possible(percent: int):
    """Whether two sets can be alike, from sizes and bitmaps: a bit that only one set has is an element that only it has."""
    shared = functools.reduce(lambda a, b: a + b, [F.bit_count(F.col(m).bitwiseAND(F.col("c_" + m))) for m in MARKS])
    common = F.least(F.col("n") - F.col("ones"), F.col("c_n") - F.col("c_ones")) + shared
    return (100 * F.least("n", "c_n") >= percent * F.greatest("n", "c_n")) & ((100 + percent) * common >= percent * (F.col("n") + F.col("c_n")))


def _unsettled(buckets: DataFrame, of: DataFrame) -> DataFrame:
    """(bucket, key, n, component) of the buckets (bucket, key, n) that hold several components."""
    state = buckets.join(of.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    several = state.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    return keep(state.join(several, "bucket", "left_semi"), "buckets")


def _largest(state: DataFrame) -> DataFrame:
    """Of each bucket its size, its largest component, a member of that (c, c_n) drawn by hash, and the number of rows outside it."""
    drawn = F.struct("key", "n")
    parts = state.groupBy("bucket", "component").agg(F.count("*").alias("size"), F.min_by(drawn, F.xxhash64("bucket", "key")).alias("drawn"))
    found = parts.groupBy("bucket").agg(F.sum("size").alias("size"), F.max(F.struct("size", "component", "drawn")).alias("top"))
    return found.select("bucket", "size", (F.col("size") - F.col("top.size")).alias("out"), F.col("top.component").alias("top"), F.col("top.drawn.key").alias("c"), F.col("top.drawn.n").alias("c_n"))


def _blocks(percent: int):
    def pairs(members: list, outer: list) -> pa.RecordBatch | None:
        (key, n, comp, bits), (o_key, o_n, o_comp, o_bits) = ([np.concatenate(c) for c in zip(*x)] for x in (members, outer))
        order = np.argsort(n, kind="stable")
        key, n, comp, bits = key[order], n[order], comp[order], bits[order]
        spare, o_spare = (m - np.bitwise_count(x).sum(1) for m, x in ((n, bits), (o_n, o_bits)))
        found = []
        for k in range(len(o_key)):
            a, b = np.searchsorted(n, -(-percent * o_n[k] // 100)), np.searchsorted(n, 100 * o_n[k] // percent, "right")
            common = np.minimum(spare[a:b], o_spare[k]) + np.bitwise_count(bits[a:b] & o_bits[k]).sum(1)
            met = a + np.flatnonzero(((100 + percent) * common >= percent * (n[a:b] + o_n[k])) & (comp[a:b] != o_comp[k]))
            found.append(np.c_[np.minimum(key[met], o_key[k]), np.maximum(key[met], o_key[k])])
        every = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], ["a", "b"]) if len(every) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, block, part, outer, key, n, component, bits), in order of the first four: members, then those they meet."""
        last, held = None, ([], [])
        for batch in batches:
            where = np.stack([batch.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(4)], 1)
            rows = [batch.column(j).to_numpy() for j in (4, 5, 6)]
            bits = batch.column(7).flatten().to_numpy().astype(np.int64).view(U64).reshape(len(batch), -1)
            cut = np.r_[0, np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1, len(batch)]
            for x, y in zip(cut[:-1], cut[1:]):
                group = tuple(where[x, :3])
                if group != last:
                    if held[0] and held[1] and (out := pairs(*held)) is not None:
                        yield out
                    last, held = group, ([], [])
                held[where[x, 3]].append((*(c[x:y].copy() for c in rows), bits[x:y].copy()))
        if held[0] and held[1] and (out := pairs(*held)) is not None:
            yield out
        trim()

    return run


def _met(state: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be alike, of each row outside its bucket's largest component with all rows of other components of the bucket.

    Both sides go in parts of about BLOCK rows, each part of one against each of the other in a task's memory; nothing is emitted
    but what passes the bound."""
    spark = state.sparkSession
    rows = state.join(_largest(state).select("bucket", "size", "out", "top"), "bucket").join(bits, "key")
    slot = lambda total, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.ceil(F.col(total) / BLOCK))
    every = lambda total: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(total) / BLOCK) - 1))
    members = rows.select("bucket", slot("size", 1).alias("block"), every("out").alias("part"), F.lit(0).alias("outer"), "key", "n", "component", "bits")
    outer = rows.where("component <> top").select("bucket", every("size").alias("block"), slot("out", 2).alias("part"), F.lit(1).alias("outer"), "key", "n", "component", "bits")
    dealt = members.unionByName(outer).repartition(partitions(spark), "bucket", "block", "part").sortWithinPartitions("bucket", "block", "part", "outer")
    return dealt.mapInArrow(_blocks(percent), "a long, b long").distinct()  # a pair may share several buckets


def _links(classes: DataFrame, docs: DataFrame, percent: int, repeats: bool) -> DataFrame:
    """Edges (a, b) with the components of all links between the classes (key, rep, set_a, n, bands, bits) of each bucket."""
    named = classes.select("key", F.col("rep").alias("doc_id"), "set_a") if repeats else None
    bits = classes.select("key", *marks("bits"))
    of_centres = bits.select(F.col("key").alias("c"), *(F.col(m).alias("c_" + m) for m in (*MARKS, "ones")))
    like_sized = 100 * F.least("n", "c_n") >= percent * F.greatest("n", "c_n")

    def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        pairs = keep(pairs, "pairs")
        links = confirm(pairs, texts, named, percent)
        forget(pairs)
        return links

    def star(met: DataFrame) -> DataFrame:
        """Pairs of met (key, n, c, c_n) that may be alike. A key has as many rows as there are bands at most, so one exchange by it does."""
        pairs = met.where((F.col("key") != F.col("c")) & like_sized).select("key", "n", "c", "c_n").repartition("key").distinct()
        near = pairs.join(bits, "key").join(of_centres, "c").where(_possible(percent))
        return near.select(F.least("c", "key").alias("a"), F.greatest("c", "key").alias("b"))

    spread = classes.select(F.explode("bands").alias("bucket"), "key", "n")
    firsts = spread.groupBy("bucket").agg(F.min(F.struct("key", "n")).alias("first"), F.max("key").alias("last")).where("first.key < last")
    shared = keep(spread.join(firsts.select("bucket", F.col("first.key").alias("c"), F.col("first.n").alias("c_n")), "bucket"), "buckets")
    links = linked(star(shared), docs)
    of = _forest(links)
    state = _unsettled(shared.select("bucket", "key", "n"), of)
    forget(shared)
    if state.isEmpty():
        return links
    ids = state.select("key")  # from now on only these come up
    ids = ids.withColumnRenamed("key", "doc_id") if named is None else ids.distinct().join(named, "key").select("doc_id")
    texts = keep(_narrowed(docs, ids, state.count()), "texts")
    more = linked(star(state.join(_largest(state), "bucket").where("component <> top").select("key", "n", "c", "c_n")), texts)
    forget(links)
    of_edges = lambda of: of.select(F.col("component").alias("a"), F.col("id").alias("b"))
    past, of = of, _forest(of_edges(of).unionByName(more))
    rest = _unsettled(state.select("bucket", "key", "n"), of)
    forget(past, state, more)
    edges = of_edges(of)
    if not rest.isEmpty():
        edges = edges.unionByName(linked(_met(rest, classes.select("key", "bits"), percent), texts))
    forget(rest, texts)
    return edges


def _classified(docs: DataFrame, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame, bool]:
    """(doc_id, n_shingles, set_a, set_b) of all rows; (set_a, set_b, n_shingles, key, rep, component) of all classes; whether ids repeat.

    by_id: rows of one id are one vertex, and component its smallest id; else texts are told apart by their classes alone."""
    rows = keep(docs.mapInArrow(_sketches, _FEATURES), "sketches")
    repeats = not rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    usable = rows.where("doc_id is not null and n_shingles > 0")
    classes = usable.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    key = F.col("rep")
    if repeats:  # an id may stand for several classes: the others get keys of their own
        place = F.row_number().over(Window.partitionBy("rep").orderBy("set_a", "set_b"))
        key = F.when(F.col("_place") == 1, F.col("rep")).otherwise(F.xxhash64("rep", "set_a", "set_b"))
        classes = classes.withColumn("_place", place)
    classes = keep(classes.select("set_a", "set_b", "n_shingles", "rep", key.alias("key"), F.col("n_shingles").alias("n"), "bands", "bits"), "classes")
    links = _links(classes, docs.where("doc_id is not null"), percent, repeats)
    if repeats and by_id:
        same = usable.join(classes.select("set_a", "set_b", "n_shingles", "key"), ["set_a", "set_b", "n_shingles"]).select("doc_id", "key").distinct()
        low = same.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("doc_id", "a")
        links = links.unionByName(same.join(low, "doc_id").where("key <> a").select("a", F.col("key").alias("b")))
    of = _forest(links).withColumnRenamed("id", "key")
    named = classes.drop("bands", "bits", "n").join(of, "key", "left").withColumn("component", F.coalesce("component", "key"))
    if repeats and by_id:
        smallest = named.groupBy("component").agg(F.min("rep").alias("smallest"))
        named = named.join(smallest, "component").drop("component").withColumnRenamed("smallest", "component")
    return rows.drop("bands", "bits"), named, repeats


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (columns doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, named, _ = _classified(docs, percent, True)
    on = ["set_a", "set_b", "n_shingles"]
    lone = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = rows.where("doc_id is not null and n_shingles > 0").join(named.select(*on, "component"), on).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return out.unionByName(lone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Stage: of each group of near-duplicates the smallest id stays, once. Rows without an id or without words stay, but for exact
    repeats of a row's id and text; rows of one id with unlike texts are different documents here."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, named, repeats = _classified(slim, 75, False)
    on = ["set_a", "set_b", "n_shingles"]
    of = rows.where("doc_id is not null and n_shingles > 0").join(named.select(*on, "component"), on)
    if not repeats:
        first = of.groupBy("component").agg(F.min("doc_id").alias("first"))
        gone = keep(of.join(first, "component").where("doc_id <> first").select("doc_id"), "gone")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    stays = of.groupBy("component").agg(F.min(F.struct("doc_id", *on)).alias("first")).select("first.*")
    free = [f"_{k}" for k in range(len(docs.columns) + 9) if f"_{k}" not in docs.columns]
    a, b, c = free[:3]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{a}` long", f"`{b}` long"])
    marked = docs.where("doc_id is not null").mapInArrow(_digested([*docs.columns, a, b], docs.columns.index("text")), schema)
    stays = keep(stays.select("doc_id", F.col("set_a").alias(a), F.col("set_b").alias(b)), "stays")
    lone = marked.where((F.col(a) == 0) & (F.col(b) == 0))
    found = marked.join(stays, ["doc_id", a, b], "left_semi").unionByName(lone)
    least = F.min(F.struct("text", *(x for x in docs.columns if x != "text"))).alias(c)
    once = found.groupBy("doc_id", a, b).agg(least).select(*(F.col(f"{c}.{x}").alias(x) for x in docs.columns))
    return once.unionByName(docs.where("doc_id is null"))
