import io
import zipfile

from mosaicveil.operators.dictionary import Matcher
from mosaicveil.plans.redact import redact_packages
from mosaicveil.sources import ooxml, tables
from mosaicveil.streaming.files import redact_stream
from mosaicveil.types import Config

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def run(text, props=""):
    return f'<w:r>{props}<w:t xml:space="preserve">{text}</w:t></w:r>'


def package(body):
    types = '<Types><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", types)
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {NS}/>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="mailto:rahul.mehta@gmail.com" TargetMode="External"/><Relationship Id="r2" Target="styles.xml"/></Relationships>')
        z.writestr("word/media/a.png", b"\x89PNG")
    return out.getvalue()


def cell(text):
    return f"<w:tc><w:p>{run(text)}</w:p></w:tc>"


BODY = (
    f"<w:p>{run('Mr. ')}{run('Rah', '<w:rPr><w:b/></w:rPr>')}{run('ul Mehta', '<w:rPr><w:i/></w:rPr>')}{run(' is here &amp; there')}</w:p>"
    f'<w:p><w:del w:author="Rahul Mehta"><w:r><w:delText>Rahul Mehta</w:delText></w:r></w:del>{run("DIN: 00123456")}<w:r><w:tab/></w:r>{run("rahul.mehta@gmail.com")}</w:p>'
    f"<w:tbl><w:tr>{cell('Name')}{cell('DIN')}</w:tr><w:tr>{cell('Anita Rao')}{cell('00999999')}</w:tr></w:tbl>"
)


def frame(spark):
    return spark.createDataFrame([("a.docx", bytearray(package(BODY)))], "doc_id string, content binary")


def test_reading(spark):
    df = frame(spark)
    texts = [r.text for r in ooxml.paragraphs(df).orderBy("unit_id").collect()]
    assert texts == ["Mr. Rahul Mehta is here & there", "DIN: 00123456\trahul.mehta@gmail.com", "Name", "DIN", "Anita Rao", "00999999"]
    assert [(r.row_no, r.col_no, r.text) for r in ooxml.grid(df).orderBy("row_no", "col_no").collect()] == [(0, 0, "Name"), (0, 1, "DIN"), (1, 0, "Anita Rao"), (1, 1, "00999999")]
    assert [r.target for r in ooxml.links(df).collect()] == ["mailto:rahul.mehta@gmail.com"]
    assert [r.part for r in ooxml.images(df).collect()] == ["word/media/a.png"]
    assert all(r.ok for r in ooxml.integrity(df).collect())


def test_only_texts_change(spark):
    done = redact_packages(frame(spark), Config(salt="s"))
    new = bytes(done.texts.first().content)
    old = zipfile.ZipFile(io.BytesIO(package(BODY))).read("word/document.xml").decode()
    xml = zipfile.ZipFile(io.BytesIO(new)).read("word/document.xml").decode()
    for gone in ("Rahul", "Mehta", "Anita", "00123456", "00999999"):
        assert gone not in xml
    assert xml.count("<w:r>") == old.count("<w:r>") and "<w:rPr><w:b/></w:rPr>" in xml and "is here &amp; there" in xml
    assert "rahul" not in zipfile.ZipFile(io.BytesIO(new)).read("word/_rels/document.xml.rels").decode()
    before, after = (ooxml.structure(spark.createDataFrame([("a", bytearray(c))], "doc_id string, content binary")) for c in (package(BODY), new))
    from mosaicveil.operators.audit import structure_changes

    assert structure_changes(before, after).count() == 0


def test_untouched_package_is_equal_inside():
    raw = package(BODY)
    new, n = ooxml.rewrite_package(raw, Matcher([]).spans)
    assert n == 0
    a, b = zipfile.ZipFile(io.BytesIO(raw)), zipfile.ZipFile(io.BytesIO(new))
    assert b.read("word/document.xml") == a.read("word/document.xml").replace(b'w:author="Rahul Mehta"', b'w:author="Redacted"')


def test_files(spark, tmp_path):
    df = frame(spark)
    ooxml.save(df, str(tmp_path / "out"))
    assert ooxml.read_packages(spark, str(tmp_path / "out")).count() == 1
    mapping = spark.createDataFrame([("PAN", "b", "c"), ("DIN", "a", "d"), ("PAN", "b", "c")], "type string, original string, pseudonym string")
    tables.write_mapping(mapping, str(tmp_path / "map"))
    assert spark.read.json(str(tmp_path / "map")).count() == 2
    (tmp_path / "gt.json").write_text('{"entities": [{"value": "x", "type": "PAN", "where": ["text"], "detect": true, "note": ""}], "negatives": ["n"]}')
    entities, negatives = tables.read_ground_truth(spark, str(tmp_path / "gt.json"))
    assert entities.first().value == "x" and negatives.first().value == "n"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "PAN ABCPK1234L"), (2, "plain")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    redact_stream(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "cp"), Config(salt="s")).awaitTermination(120)
    rows = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[2] == "plain" and "ABCPK1234L" not in rows[1] and rows[1].startswith("PAN ")


def test_paint():
    from mosaicveil.operators.ocr import paint

    raw = bytes(range(48)) * 4
    assert paint(raw, 8, 8, 3, [(0, 0, 8, 8)]) == bytes(192)
    assert paint(raw, 8, 8, 3, []) == raw
