"""Word packages: parts, paragraphs, tables, links and images as rows; and packages written back with only the changed bytes replaced.

A package is one binary row (Spark's binaryFile source). Parts are parsed with expat, which gives byte offsets, so the writer can
splice new text into the old XML and leave every other byte as it was.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape, unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
# Content types whose XML is no text, and those that may hold some.
_NO_TEXT = ("styles", "settings", "fontTable", "webSettings", "numbering", "theme")
_TEXT = ("wordprocessingml", "core-properties", "extended-properties", "custom-properties", "drawingml.chart", "diagramData")
ATTRIBUTES = ("author", "initials", "userId", "providerId", "lastModifiedBy")
SHOWN_ATTRIBUTES = ("descr", "title", "instr")
NAMED_ELEMENTS = ("docPr", "cNvPr")
_DROPPED = ("del", "moveFrom")


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content): the packages of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select(F.col("path").alias("doc_id"), "content")


def _content_types(z: zipfile.ZipFile) -> dict[str, str]:
    kinds: dict[str, str] = {}
    default: dict[str, str] = {}

    def start(name, attrs):
        if name.endswith("Override"):
            kinds[attrs["PartName"].lstrip("/")] = attrs["ContentType"]
        elif name.endswith("Default"):
            default[attrs["Extension"].lower()] = attrs["ContentType"]

    p = expat.ParserCreate()
    p.StartElementHandler = start
    p.Parse(z.read("[Content_Types].xml"), True)
    return {n: kinds.get(n, default.get(n.rpartition(".")[2].lower(), "")) for n in z.namelist()}


def is_text_part(kind: str) -> bool:
    return kind.endswith("xml") and not any(x in kind for x in _NO_TEXT) and any(x in kind for x in _TEXT)


class Part:
    """Texts of one XML part with their byte ranges, its paragraphs and its tables."""

    def __init__(self, xml: bytes):
        self.xml = xml
        self.texts: list[tuple[int, int, str, int | None, str]] = []  # first byte, end, text, paragraph, element
        self.paragraphs: list[list[tuple[int | None, str]]] = []  # of (place in texts, text)
        self.cells: list[tuple[int, int, int, list[int]]] = []  # table, row, column, paragraphs
        stack: list[str] = []
        open_p: list[int] = []
        open_t: list[list[int]] = []  # table, row, column
        tables = 0
        p = expat.ParserCreate(namespace_separator="}")
        p.buffer_text = False
        current: list | None = None

        def local(name: str) -> str:
            return name.rpartition("}")[2]

        def hidden() -> bool:
            inner = stack[len(stack) - stack[::-1].index("p") :] if "p" in stack else stack
            return any(s in _DROPPED or s.endswith("Pr") for s in inner)

        def start(name, attrs):
            nonlocal current, tables
            tag = local(name)
            stack.append(tag)
            if tag == "p" and name.startswith(W):
                open_p.append(len(self.paragraphs))
                self.paragraphs.append([])
                if open_t:
                    self.cells[-1][3].append(open_p[-1]) if self.cells and self.cells[-1][:3] == tuple(open_t[-1]) else None
            elif tag == "tbl":
                open_t.append([tables, -1, -1])
                tables += 1
            elif tag == "tr" and open_t:
                open_t[-1][1:] = [open_t[-1][1] + 1, -1]
            elif tag == "tc" and open_t:
                open_t[-1][2] += 1
                self.cells.append((*open_t[-1], []))
            elif open_p and not hidden():
                mark = {"tab": "\t", "ptab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}.get(tag)
                if mark and name.startswith(W):
                    self.paragraphs[open_p[-1]].append((None, mark))
            current = None

        def end(name):
            nonlocal current
            tag = stack.pop()
            if tag == "p" and open_p:
                open_p.pop()
            elif tag == "tbl" and open_t:
                open_t.pop()
            current = None

        def data(text):
            nonlocal current
            at = p.CurrentByteIndex
            if current is not None and self.texts[current][1] == at:
                first, _, old, par, tag = self.texts[current]
                self.texts[current] = (first, None, old + text, par, tag)
            else:
                shown = stack and stack[-1] == "t" and open_p and not hidden()
                self.texts.append((at, None, text, open_p[-1] if shown else None, stack[-1] if stack else ""))
                current = len(self.texts) - 1
                if shown:
                    self.paragraphs[open_p[-1]].append((current, text))
            first, _, old, par, tag = self.texts[current]
            if par is not None:
                seg = self.paragraphs[par]
                k = next(i for i in range(len(seg) - 1, -1, -1) if seg[i][0] == current)
                seg[k] = (current, old)
            pending.append(current)

        pending: list[int] = []

        def close(*_):
            """The end of a text is where the next event starts."""
            for k in set(pending):
                first, last, text, par, tag = self.texts[k]
                if last is None:
                    self.texts[k] = (first, p.CurrentByteIndex, text, par, tag)
            pending.clear()

        p.StartElementHandler = lambda n, a: (close(), start(n, a))
        p.EndElementHandler = lambda n: (close(), end(n))
        p.CharacterDataHandler = lambda t: (close(), data(t))
        p.CommentHandler = p.ProcessingInstructionHandler = lambda *a: close()
        p.Parse(xml, True)

    def paragraph_texts(self) -> list[str]:
        return ["".join(t for _, t in p) for p in self.paragraphs]

    def spliced(self, changes: dict[int, str]) -> bytes:
        """The XML with some texts replaced, all else byte for byte."""
        out, at = [], 0
        for k in sorted(changes, key=lambda k: self.texts[k][0]):
            first, end, *_ = self.texts[k]
            out += [self.xml[at:first], escape(changes[k]).encode()]
            at = end
        return b"".join(out) + self.xml[at:]


def _open(content: bytes) -> Iterator[tuple[str, str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        kinds = _content_types(z)
        for name in z.namelist():
            yield name, kinds[name], z.read(name)


def _parts(content: bytes) -> Iterator[tuple[str, Part]]:
    for name, kind, raw in _open(content):
        if is_text_part(kind):
            try:
                yield name, Part(raw)
            except expat.ExpatError:
                continue


def _rows(make, schema: str):
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, content in zip(frame["doc_id"], frame["content"]):
                yield pd.DataFrame([(doc, *r) for r in make(bytes(content))], columns=names)

    return lambda packages: packages.select("doc_id", "content").mapInPandas(run, schema)


def _paragraph_rows(content: bytes):
    for name, part in _parts(content):
        texts = part.paragraph_texts()
        if any(t.strip() for t in texts):
            yield from ((name, k, t) for k, t in enumerate(texts))
        else:  # no paragraph has text: every element's own
            yield from ((name, k, t[2]) for k, t in enumerate(part.texts) if t[2].strip())


def _cell_rows(content: bytes):
    for name, part in _parts(content):
        texts = part.paragraph_texts()
        for table, row, col, own in part.cells:
            yield name, table, row, col, "\n".join(texts[k] for k in own).strip()


def _link_rows(content: bytes):
    for name, _, raw in _open(content):
        if name.endswith(".rels"):
            links: list[tuple[str, str, str]] = []
            p = expat.ParserCreate()
            p.StartElementHandler = lambda n, a: links.append((name, a["Id"], a["Target"])) if a.get("TargetMode") == "External" else None
            p.Parse(raw, True)
            yield from links


def _integrity_rows(content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        bad = z.testzip()
        for name in z.namelist():
            ok, why = name != bad, "crc" if name == bad else ""
            if ok and name.endswith((".xml", ".rels")):
                try:
                    expat.ParserCreate().Parse(z.read(name), True)
                except expat.ExpatError as e:
                    ok, why = False, str(e)
            yield name, ok, why


paragraphs = _rows(_paragraph_rows, "doc_id string, part string, unit_id int, text string")
grid = _rows(_cell_rows, "doc_id string, part string, table_id int, row_no int, col_no int, text string")
links = _rows(_link_rows, "doc_id string, part string, rel_id string, target string")
images = _rows(lambda c: ((n, k, b) for n, k, b in _open(c) if k.startswith("image/")), "doc_id string, part string, kind string, data binary")
integrity = _rows(_integrity_rows, "doc_id string, part string, ok boolean, why string")


def part_texts(rows: DataFrame) -> DataFrame:
    """(doc_id, part, text): paragraphs joined by line feeds, in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id", "part").agg(F.array_join(lines, "\n").alias("text"))


def _structure_rows(content: bytes):
    for name, part in _parts(content):
        for tag in ("p", "r", "tbl", "sectPr", "hyperlink", "drawing"):
            yield f"{name}:{tag}", len(re.findall(rf"<w:{tag}[ />]".encode(), part.xml))
        runs = b"".join(re.findall(rb"<w:rPr>.*?</w:rPr>", part.xml, re.S))
        yield f"{name}:formats", zlib.crc32(runs)


structure = _rows(_structure_rows, "doc_id string, metric string, n long")


def rewrite_package(content: bytes, replace, redact: str = "Redacted") -> tuple[bytes, int]:
    """(package, replacements): replace(text) -> spans (start, end, new). Paragraph texts, other texts, external links and authors."""
    from ..operators.dictionary import project

    out, total = io.BytesIO(), 0
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        kinds = _content_types(z)
        for info in z.infolist():
            raw = z.read(info.filename)
            if is_text_part(kinds[info.filename]):
                try:
                    part = Part(raw)
                except expat.ExpatError:
                    part = None
                if part is not None:
                    changes: dict[int, str] = {}
                    for segs in part.paragraphs:
                        spans = replace("".join(t for _, t in segs))
                        total += len(spans)
                        for (node, old), (_, new) in zip(segs, project([(n if n is not None else -1, t) for n, t in segs], spans)) if spans else ():
                            if node is not None and new != old:
                                changes[node] = new
                    for k, (_, _, text, par, _) in enumerate(part.texts):
                        if par is None and text.strip() and (spans := replace(text)):
                            total += len(spans)
                            for s, e, new in reversed(spans):
                                text = text[:s] + new + text[e:]
                            changes[k] = text
                    raw = part.spliced(changes)
                    raw = re.sub(rb'(\bw(?:\d+)?:(?:' + "|".join(ATTRIBUTES).encode() + rb')=)"[^"]*"', rb'\1"' + redact.encode() + b'"', raw)

                    def attribute(m):
                        nonlocal total
                        text = unescape(m[2].decode(), {"&quot;": '"'})
                        spans = replace(text)
                        total += len(spans)
                        for s, e, new in reversed(spans):
                            text = text[:s] + new + text[e:]
                        return m[1] + (escape(text, {'"': "&quot;"}).encode() if spans else m[2]) + m[3]

                    raw = re.sub(rb'(\s(?:\w+:)?(?:' + "|".join(SHOWN_ATTRIBUTES).encode() + rb')=")([^"]*)(")', attribute, raw)
                    raw = re.sub(rb"(<(?:\w+:)?(?:" + "|".join(NAMED_ELEMENTS).encode() + rb')\b[^>]*?\sname=")([^"]*)(")', attribute, raw)
                    raw = re.sub(rb"(<(?:dc:creator|cp:lastModifiedBy)>)[^<]*", rb"\1" + redact.encode(), raw)
                    raw = re.sub(rb"(<(?:Company|Manager)>)[^<]*", rb"\1", raw)
            elif info.filename.endswith(".rels"):

                def target(m):
                    nonlocal total
                    text = m[2].decode()
                    for s, e, new in reversed(replace(text)):
                        total += 1
                        text = text[:s] + escape(new) + text[e:]
                    return m[1] + text.encode() + m[3]

                raw = re.sub(rb'(<[^>]*?Target=")([^"]*)("[^>]*TargetMode="External")', target, raw)
            made.writestr(info, raw)
    return out.getvalue(), total


def rewrite(packages: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, content, n_replaced): each package rewritten with its own dictionary (doc_id, ord, type, original, pseudonym, part)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..operators.dictionary import Matcher

        for frame in frames:
            for doc, content, table in zip(frame["doc_id"], frame["content"], frame["_map"]):
                matcher = Matcher([(p["type"], p["original"], p["pseudonym"], p["part"]) for p in (table if table is not None else [])])
                new, n = rewrite_package(bytes(content), matcher.spans)
                yield pd.DataFrame([(doc, new, n)], columns=["doc_id", "content", "n_replaced"])

    whole = mapping.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "type", "original", "pseudonym", "part"))).alias("_map"))
    return packages.select("doc_id", "content").join(whole, "doc_id", "left").mapInPandas(run, "doc_id string, content binary, n_replaced long")


def save(packages: DataFrame, folder: str) -> None:
    """One file a package, written by the tasks that hold it. The folder must be local to all of them or mounted by all (a shared
    file system); for a store that only Spark reaches use save_table. Packages of one name get their path's crc32 before it."""

    def write(rows) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, r["_name"]), "wb") as f:
                f.write(r["content"])

    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("save writes through the file system; use save_table for other stores")
    folder = folder.removeprefix("file://")
    name = F.element_at(F.split("doc_id", "/"), -1)
    several = packages.groupBy(name.alias("_base")).agg(F.count("*").alias("_n")).where("_n > 1")
    rows = packages.select("doc_id", "content", name.alias("_base")).join(several, "_base", "left")
    told = F.when(F.col("_n").isNull(), F.col("_base")).otherwise(F.concat(F.hex(F.crc32(F.col("doc_id").cast("binary"))), F.lit("-"), "_base"))
    rows.select("content", told.alias("_name")).foreachPartition(write)


def save_table(packages: DataFrame, path: str) -> None:
    """doc_id and content as Parquet, wherever Spark writes."""
    packages.select("doc_id", "content").write.mode("overwrite").parquet(path)


def _harvest_rows(content: bytes):
    """Whatever a reader of the package might see: texts, attributes of over three characters, links."""
    for name, part in _parts(content):
        yield from ((name, "text", t) for t in part.paragraph_texts() if t.strip())
        yield from ((name, "text", t) for _, _, t, par, _ in part.texts if par is None and t.strip())
        found: list[str] = []
        p = expat.ParserCreate()
        p.StartElementHandler = lambda n, a: found.extend(v for k, v in a.items() if len(v) > 3 and not k.startswith("xmlns"))
        p.Parse(part.xml, True)
        yield from ((name, "attribute", v) for v in found)
    yield from ((name, "link", target) for name, _, target in _link_rows(content))


harvest = _rows(_harvest_rows, "doc_id string, part string, kind string, text string")
