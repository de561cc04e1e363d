"""Recognised words of scanned images: lines, identity-card rules, boxes. Words come as a table (image, block, par, line, text, left, top, width, height, conf)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import Config
from .names import free_text_spans
from .resolve import detect

#: Words of identity cards; two of them make an image one.
ID_WORDS = ("income tax", "permanent account", "govt", "government of india", "aadhaar", "aadhar", "unique identification", "date of birth", "dob", "father", "enrolment", "vid", "male", "female", "passport", "election commission", "driving licence", "आधार")
#: Printed words of cards that are no part of a name.
_BOILERPLATE = sorted({w for phrase in ID_WORDS for w in phrase.split() if w.isascii()} | set("authority birth blood card country date department expiry gender given group identity india issue issued mother name nationality no number of place republic sex signature state surname the to union valid year".split()))
_RELATIVE = r"[sdwc]\s*/\s*o"
_LABEL = rf"(?i)\b(?:(?:(?:father|mother|husband|spouse|guardian)'?s?\s*)?name|{_RELATIVE})\b\s*[:\-.]?\s*"
#: What opens an address block, a relative's name at its head, a PIN code; lines of a card beside its photograph.
_ADDRESS = r"(?i)\baddress\b\s*[:\-.]?\s*"
_WHOSE = rf"(?i)^{_RELATIVE}\s*[:.]?\s*([A-Za-z][A-Za-z.'\-]*(?:\s+[A-Za-z][A-Za-z.'\-]*){{0,3}})\s*,[ ,]*"
_BESIDE = r"\b(father|mother|husband|dob|date\s+of\s+birth|year\s+of\s+birth|male|female)\b"
_PIN = r"(?<!\d)[1-9]\d{2}\s?\d{3}(?!\d)"
MIN_SIDE = 120


def lines(words: DataFrame, scale: float = 1.0) -> DataFrame:
    """(image, line_no, text, words): words by their left edge, lines by top and left; blank and unsure words go. Offsets run through the line."""
    usable = words.where((F.trim("text") != "") & (F.col("conf") >= 0))
    box = [F.floor(F.col(c) / scale).cast("int").alias(c) for c in ("left", "top", "width", "height")]
    rows = usable.select("image", "block", "par", "line", F.trim("text").alias("text"), *box)
    grouped = rows.groupBy("image", "block", "par", "line").agg(F.array_sort(F.collect_list(F.struct("left", "top", "width", "height", "text"))).alias("words"), F.min("top").alias("_top"), F.min("left").alias("_left"))
    start = lambda i: F.aggregate(F.slice("words", 1, i), F.lit(0), lambda a, w: a + F.length(w["text"]) + 1)
    placed = F.transform("words", lambda w, i: F.struct(F.when(i > 0, start(i)).otherwise(0).cast("int").alias("start"), (F.when(i > 0, start(i)).otherwise(0) + F.length(w["text"])).cast("int").alias("end"), w["left"].alias("left"), w["top"].alias("top"), w["width"].alias("width"), w["height"].alias("height"), w["text"].alias("text")))
    order = Window.partitionBy("image").orderBy("_top", "_left", "block", "par", "line")
    return grouped.select("image", (F.row_number().over(order) - 1).alias("line_no"), F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"), placed.alias("words"))


def id_document(ocr_lines: DataFrame) -> DataFrame:
    """(image, is_id)."""
    text = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n"))
    hits = sum((F.when(F.contains(F.col("all"), F.lit(w)), 1).otherwise(0) for w in ID_WORDS), F.lit(0))
    return ocr_lines.groupBy("image").agg(text.alias("all")).select("image", (hits >= 2).alias("is_id"))


def name_like(c: Column) -> Column:
    words = F.split(F.trim(c), r"\s+")
    return F.size(words).between(2, 4) & F.forall(words, lambda w: w.rlike(r"^[A-Za-z][A-Za-z.'-]*$") & ~F.regexp_replace(F.lower(w), r"^[.']+|[.']+$", "").isin(*_BOILERPLATE))


def id_hits(ocr_lines: DataFrame) -> DataFrame:
    """(image, line_no, start, end, type, text, source) on identity documents: labelled names, address blocks and the relatives that they
    name first, lines in capitals."""
    w = Window.partitionBy("image").orderBy("line_no")
    rows = ocr_lines.select("image", "line_no", "text").withColumn("next", F.lead("text").over(w)).withColumn("next_no", F.lead("line_no").over(w))
    label_end = F.length(F.regexp_extract("text", rf"^(?s:.*?){_LABEL}", 0))
    rest = F.regexp_replace(F.split(F.col("text").substr(label_end + 1, F.length("text")), ",")[0], r"^[ :\-.]+|[ :\-.]+$", "")
    labelled = rows.where(F.col("text").rlike(_LABEL)).withColumn("rest", rest).withColumn("long", F.length(F.regexp_replace("rest", "[^A-Za-z]", "")) >= 3)
    inline = labelled.where("long").withColumn("start", label_end + F.length(F.regexp_extract(F.col("text").substr(label_end + 1, F.length("text")), r"^[ :\-.]*", 0)))
    inline = inline.select("image", "line_no", "start", (F.col("start") + F.length("rest")).alias("end"), F.lit("PERSON").alias("type"), F.col("rest").alias("text"), F.lit("id_label_inline").alias("source"))
    below = labelled.where(~F.col("long") & name_like(F.col("next"))).select("image", F.col("next_no").alias("line_no"), F.lit(0).alias("start"), F.length("next").alias("end"), F.lit("PERSON").alias("type"), F.col("next").alias("text"), F.lit("id_label_nextline").alias("source"))
    caps = rows.where(name_like(F.col("text")) & (F.col("text") == F.upper("text"))).select("image", "line_no", F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("PERSON").alias("type"), "text", F.lit("id_caps_line").alias("source"))
    # address blocks: from a label on, seven lines at most, to the first with a PIN code
    opened = F.last(F.when(F.col("text").rlike(_ADDRESS), F.col("line_no")), ignorenulls=True).over(w)
    block = rows.withColumn("from", opened).where(F.col("from").isNotNull() & (F.col("line_no") - F.col("from") <= 6))
    pins = F.sum(F.when(F.col("text").rlike(_PIN), 1).otherwise(0)).over(Window.partitionBy("image", "from").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    block = block.withColumn("pins", F.coalesce(pins, F.lit(0))).where("pins = 0")
    cut = F.when(F.col("line_no") == F.col("from"), F.length(F.regexp_extract("text", rf"^(?s:.*?){_ADDRESS}", 0))).otherwise(0)
    block = block.withColumn("cut", cut).withColumn("seg", F.regexp_replace(F.col("text").substr(F.col("cut") + 1, F.length("text")), "^ +| +$", ""))
    block = block.withColumn("start", F.col("cut") + F.length(F.regexp_extract(F.col("text").substr(F.col("cut") + 1, F.length("text")), "^ *", 0))).where("seg <> ''")
    related = F.when(F.col("line_no") == F.col("from"), F.regexp_extract("seg", _WHOSE, 0)).otherwise("")
    block = block.withColumn("lead", related).withColumn("who", F.regexp_extract("seg", _WHOSE, 1)).withColumn("who_at", F.col("start") + F.instr("lead", F.col("who")) - 1)
    relation = block.where("lead <> ''").select("image", "line_no", F.col("who_at").alias("start"), (F.col("who_at") + F.length("who")).alias("end"), F.lit("PERSON").alias("type"), F.col("who").alias("text"), F.lit("id_relation").alias("source"))
    block = block.withColumn("start", F.col("start") + F.length("lead")).withColumn("seg", F.col("seg").substr(F.length("lead") + 1, F.length("seg"))).where("seg <> ''")
    address = block.select("image", "line_no", "start", (F.col("start") + F.length("seg")).alias("end"), F.lit("ADDRESS").alias("type"), F.col("seg").alias("text"), F.lit("id_address_block").alias("source"))
    return inline.unionByName(below).unionByName(caps).unionByName(relation).unionByName(address).withColumn("start", F.col("start").cast("int")).withColumn("end", F.col("end").cast("int"))


def line_hits(ocr_lines: DataFrame, is_id: DataFrame, config: Config = Config()) -> DataFrame:
    """Hits of the general recognizers in each line; on identity documents (image, is_id) dates need no cue."""
    rows = ocr_lines.select("image", "line_no", "text").join(is_id, "image", "left")
    rows = detect(rows, config=config, extra=(free_text_spans(),), id_context=F.coalesce("is_id", F.lit(False)))
    return rows.select("image", "line_no", F.explode("spans").alias("s")).select("image", "line_no", "s.start", "s.end", "s.type", "s.text", "s.source")


def all_hits(ocr_lines: DataFrame, config: Config = Config()) -> DataFrame:
    """What is to be hidden in images: hits of every line, on identity documents those of their layout too."""
    is_id = id_document(ocr_lines)
    cards = ocr_lines.join(is_id.where("is_id").select("image"), "image", "left_semi")
    return dedupe_hits(line_hits(ocr_lines, is_id, config).unionByName(id_hits(cards)))


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """The longest hits of a line first, labels before blocks before others; what overlaps a kept one goes."""
    prior = F.when(F.col("source").isin("id_label_inline", "id_label_nextline", "id_relation"), 3).when(F.col("source") == "id_address_block", 2).otherwise(1)
    fields = ("start", "end", "type", "text", "source")
    keyed = F.struct((F.col("start") - F.col("end")).alias("a"), (-prior).alias("b"), F.col("start").alias("c"), F.struct(*fields).alias("hit"))
    rows = hits.groupBy("image", "line_no").agg(F.array_sort(F.collect_list(keyed)).alias("all"))
    kind = "array<struct<start:int,end:int,type:string,text:string,source:string>>"
    kept = F.aggregate(F.transform("all", lambda k: k["hit"]), F.array().cast(kind), lambda acc, h: F.when(F.exists(acc, lambda k: (k["start"] < h["end"]) & (h["start"] < k["end"])), acc).otherwise(F.concat(acc, F.array(h)).cast(kind)))
    return rows.select("image", "line_no", F.explode(kept).alias("h")).select("image", "line_no", "h.*")


def hit_boxes(ocr_lines: DataFrame, hits: DataFrame) -> DataFrame:
    """Each hit with the box around the words that it overlaps."""
    words = ocr_lines.select("image", "line_no", F.explode("words").alias("w"))
    joined = hits.join(words, ["image", "line_no"]).where((F.col("start") < F.col("w.end")) & (F.col("w.start") < F.col("end")))
    box = (F.min("w.left").alias("x0"), F.min("w.top").alias("y0"), F.max(F.col("w.left") + F.col("w.width")).alias("x1"), F.max(F.col("w.top") + F.col("w.height")).alias("y1"))
    return joined.groupBy("image", "line_no", "start", "end", "type", "source").agg(*box)


def text_cover(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """(image, box_id, cover): share of each box (image, box_id, x0, y0, x1, y1) that words cover."""
    side = lambda a, b, c, d: F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))
    both = boxes.join(words.where((F.trim("text") != "") & (F.col("conf") >= 0)), "image", "left")
    area = side(F.col("x0"), F.col("x1"), F.col("left"), F.col("left") + F.col("width")) * side(F.col("y0"), F.col("y1"), F.col("top"), F.col("top") + F.col("height"))
    whole = F.greatest(F.lit(1), (F.max("x1") - F.max("x0")) * (F.max("y1") - F.max("y0")))
    return both.groupBy("image", "box_id").agg((F.coalesce(F.sum(area), F.lit(0)) / whole).alias("cover"))


def image_action(images: DataFrame, hits: DataFrame) -> DataFrame:
    """(image, action): skip small images, paint those with hits, obscure identity documents without one, leave the rest."""
    n = hits.groupBy("image").agg(F.count("*").alias("n"))
    small = F.least("width", "height") < MIN_SIDE
    return images.join(n, "image", "left").select("image", F.when(small, "skip").when(F.coalesce("n", F.lit(0)) > 0, "paint").when(F.col("is_id"), "obscure").otherwise("leave").alias("action"))


def _line_boxes(ocr_lines: DataFrame) -> DataFrame:
    """(image, lines): an image's lines in order, with lower-cased text and box."""
    edge = lambda f, x: f(F.transform("words", x))
    box = F.struct(
        "line_no", F.lower("text").alias("low"), "text", edge(F.array_min, lambda w: w["left"]).alias("x0"), edge(F.array_min, lambda w: w["top"]).alias("y0"),
        edge(F.array_max, lambda w: w["left"] + w["width"]).alias("x1"), edge(F.array_max, lambda w: w["top"] + w["height"]).alias("y1"),
    )
    return ocr_lines.where(F.size("words") > 0).groupBy("image").agg(F.array_sort(F.collect_list(box)).alias("lines"))


def portrait_from_layout(ocr_lines: DataFrame, images: DataFrame) -> DataFrame:
    """(image, x0, y0, x1, y1, source): where a card without a found face has its photograph.

    On tax cards between the department's line and the name's label, left of the card's title; on identity cards left of the lines of
    personal data, as high as they are and a quarter more each way. images: (image, width, height). Fixed values: the margins."""
    rows = _line_boxes(ocr_lines).join(images.select("image", "height"), "image")
    first = lambda pattern, after=None: F.get(F.filter("lines", lambda x: x["low"].rlike(pattern) & (F.lit(True) if after is None else x["line_no"] >= after)), 0)
    rows = rows.withColumn("tax", first(r"income\s*tax")).withColumn("title", first(r"permanent\s+account")).withColumn("name", first(r"\bname\b", F.col("title.line_no")))
    card = F.struct(F.greatest(F.lit(0), F.col("name.x0") - 8).alias("x0"), (F.col("tax.y1") + 4).alias("y0"), (F.col("title.x0") - 6).alias("x1"), (F.col("name.y0") - 4).alias("y1"), F.lit("pan_layout").alias("source"))
    data = F.filter("lines", lambda x: x["low"].rlike(_BESIDE))
    rows = rows.withColumn("data", data).withColumn("from", F.get("data", 0)["line_no"]).withColumn("to", F.element_at(F.when(F.size("data") > 0, F.col("data")), -1)["line_no"])
    above = F.get(F.filter("lines", lambda x: x["line_no"] == F.col("from") - 1), 0)
    rows = rows.withColumn("from", F.when(name_like(above["text"]), F.col("from") - 1).otherwise(F.col("from")))
    block = F.filter("lines", lambda x: x["line_no"].between(F.col("from"), F.col("to")))
    side = lambda f, c: f(F.transform("block", lambda x: x[c]))
    rows = rows.withColumn("block", block).withColumn("low", side(F.array_min, "y0")).withColumn("high", side(F.array_max, "y1")).withColumn("pad", F.floor(0.25 * (F.col("high") - F.col("low"))).cast("int"))
    rows = rows.withColumn("y0", F.greatest(F.lit(0), F.col("low") - F.col("pad"))).withColumn("y1", F.least(F.col("height"), F.col("high") + F.col("pad"))).withColumn("x1", side(F.array_min, "x0") - 6)
    other = F.struct(F.greatest(F.lit(0), F.floor(F.col("x1") - 0.85 * (F.col("y1") - F.col("y0"))).cast("int")).alias("x0"), "y0", "x1", "y1", F.lit("aadhaar_layout").alias("source"))
    wide = lambda b: (b["x1"] - b["x0"] > 20) & (b["y1"] - b["y0"] > 20)
    told = rows.withColumn("box", F.when(wide(card), card).when(wide(other), other)).where("box is not null")
    return told.select("image", "box.*")


def portrait_from_face(faces: DataFrame, words: DataFrame, images: DataFrame) -> DataFrame:
    """(image, x0, y0, x1, y1): face boxes (image, x0, y0, x1, y1) widened to the whole photograph, up to two pixels from the words around.
    Fixed values: 0.45 of the face to the left, right and above, 0.75 below."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = faces.join(images.select("image", "width", "height"), "image")
    grown = (F.greatest(F.lit(0), F.floor(F.col("x0") - 0.45 * w)), F.greatest(F.lit(0), F.floor(F.col("y0") - 0.45 * h)), F.least(F.col("width"), F.floor(F.col("x1") + 0.45 * w)), F.least(F.col("height"), F.floor(F.col("y1") + 0.75 * h)))
    rows = rows.withColumns({k: c.cast("int") for k, c in zip(("grown_x0", "grown_y0", "grown_x1", "grown_y1"), grown)}).withColumn("face", F.monotonically_increasing_id())
    near = words.select("image", F.col("left").alias("a"), F.col("top").alias("b"), (F.col("left") + F.col("width")).alias("c"), (F.col("top") + F.col("height")).alias("d"))
    met = rows.drop("width", "height").join(near, "image", "left")
    inside = (F.col("c") > F.col("grown_x0")) & (F.col("a") < F.col("grown_x1")) & (F.col("d") > F.col("grown_y0")) & (F.col("b") < F.col("grown_y1"))
    below = inside & (F.col("b") >= F.col("y1")) & (F.col("a") < F.col("x1")) & (F.col("c") > F.col("x0"))
    right, left, above = inside & ~below & (F.col("a") >= F.col("x1")), inside & ~below & (F.col("c") <= F.col("x0")), inside & ~below & (F.col("d") <= F.col("y0"))
    left, above = left & ~right, above & ~right & ~left
    cut = lambda f, ok, to, box: F.coalesce(f(F.when(ok, to)), F.first(box))
    out = met.groupBy("image", "face").agg(
        F.greatest(F.first("grown_x0"), cut(F.max, left, F.col("c") + 2, "grown_x0")).alias("x0"), F.greatest(F.first("grown_y0"), cut(F.max, above, F.col("d") + 2, "grown_y0")).alias("y0"),
        F.least(F.first("grown_x1"), cut(F.min, right, F.col("a") - 2, "grown_x1")).alias("x1"), F.least(F.first("grown_y1"), cut(F.min, below, F.col("b") - 2, "grown_y1")).alias("y1"),
    )
    return out.drop("face")


def colours(raster: np.ndarray, box: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ground, ink) of a box: the median of the pixels just around it, the median of its darkest tenth."""
    x0, y0, x1, y1 = box
    outer = raster[max(0, y0 - 2) : y1 + 2, max(0, x0 - 2) : x1 + 2].reshape(-1, raster.shape[2])
    inner = raster[max(0, y0) : y1, max(0, x0) : x1].reshape(-1, raster.shape[2])
    if not len(inner):
        return np.zeros(raster.shape[2], np.uint8), np.zeros(raster.shape[2], np.uint8)
    rim = np.concatenate([raster[max(0, y0 - 2) : max(0, y0), max(0, x0) : x1].reshape(-1, raster.shape[2]), raster[y1 : y1 + 2, max(0, x0) : x1].reshape(-1, raster.shape[2])])
    dark = inner[np.argsort(inner.sum(1, dtype=np.int64), kind="stable")[: max(1, len(inner) // 10)]]
    return np.median(rim if len(rim) else outer, 0).astype(np.uint8), np.median(dark, 0).astype(np.uint8)


POLICIES = ("mask", "blur", "replace", "banner")


def paint(raster: bytes, width: int, height: int, channels: int, boxes: list[tuple[int, int, int, int]], policy: str = "mask") -> bytes:
    """A raster (rows of interleaved channels) with its boxes black (mask), in blocks of 16 pixels (blur) or in the colour around them
    (replace); banner turns an image with any box all grey."""
    img = np.frombuffer(raster, np.uint8).reshape(height, width, channels).copy()
    if policy == "banner" and boxes:
        img[:] = 200
        return img.tobytes()
    for x0, y0, x1, y1 in boxes:
        part = img[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)]
        if policy == "mask":
            part[:] = 0
        elif policy == "replace":
            part[:] = colours(img, (x0, y0, x1, y1))[0]
        else:
            for y in range(0, part.shape[0], 16):
                for x in range(0, part.shape[1], 16):
                    part[y : y + 16, x : x + 16] = part[y : y + 16, x : x + 16].mean((0, 1)).astype(np.uint8)
    return img.tobytes()


def paint_images(images: DataFrame, boxes: DataFrame, policy: str = "mask") -> DataFrame:
    """images (image, width, height, channels, raster) with the boxes (image, x0, y0, x1, y1) of each painted; an image without boxes, a
    raster of another size or null stays as it is."""
    if policy not in POLICIES:
        raise ValueError(f"one of {POLICIES}")
    own = boxes.groupBy("image").agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1"))))).alias("boxes"))
    rows = images.select("image", "width", "height", "channels", "raster").join(own, "image", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = []
            for r in f.itertuples(index=False):
                fits = r.boxes is not None and r.raster is not None and len(r.raster) == r.width * r.height * r.channels
                done.append(paint(bytes(r.raster), r.width, r.height, r.channels, [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in r.boxes], policy) if fits else r.raster)
            yield f.assign(raster=done)[["image", "width", "height", "channels", "raster"]]

    return rows.mapInPandas(run, images.select("image", "width", "height", "channels", "raster").schema)
