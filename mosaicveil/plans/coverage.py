"""Registered queries for free-text finders, the dictionary, rewriting, evaluation, images and packages, with their SQL.

As in the queries module, texts are made from table columns and the SQL side composes what must come out; it detects nothing."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fakes, scalars as S
from ..operators import audit, dictionary, names, ocr
from ..operators.resolve import admissible, detect, span_rows
from ..sources import ooxml, tables
from ..types import Config
from .queries import _DIGITS, _K, _L, _LUHN_SUM, _N, _made_spans, QUERIES, SALT, SQL, query, read
from .redact import redact_texts, self_audit, shown

_at = lambda words, m=1: f"element_at(array({', '.join(repr(w) for w in words)}), int({_K} * {m} % {len(words)}) + 1)"
_at_sql = lambda words, m=1: f"[{', '.join(repr(w) for w in words)}][CAST({_K} * {m} % {len(words)} AS INT) + 1]"
_ODD_FIRST, _ODD_LAST = ("Quorra", "Zelmira", "Ximenes", "Brontolo", "Plinius"), ("Zorgo", "Vexley", "Umbrath")
_GIVEN, _LAST = ("Kiran", "Anita", "Rahul", "Priya"), ("Mehta", "Rao", "Shah")


def _customers(spark, sf_dir, text: str, *more) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col(_K), F.expr(text).alias("text"), *more)


# --- people, organisations, addresses ------------------------------------------------------------------------------------------


def _recovered(name: str, kind: str, source: str, lead: str, value: str, tail: str, sql_value: str | None = None) -> None:
    """Registers recover_<name>: the one span of the text lead, value, tail."""

    def run(spark, sf_dir):
        rows = detect(_customers(spark, sf_dir, f"({lead}) || ({value}) || ({tail})"), extra=(names.free_text_spans(),))
        return span_rows(rows, _K).select(_K, "type", "start", "end", "text", "source")

    run.__name__ = f"recover_{name}"
    QUERIES[run.__name__] = run
    v = sql_value or value
    SQL[run.__name__] = f"""SELECT {_K}, '{kind}' AS type, CAST(length({lead}) AS INT) AS start, CAST(length({lead}) + length({v}) AS INT) AS "end", {v} AS text, '{source}' AS source FROM customer"""


_two = lambda at, a, b: f"{at(a)} || ' ' || {at(b, 7)}"
_recovered("person_honorific", "PERSON", "honorific", "'we met Mr. '", _two(_at, _ODD_FIRST, _ODD_LAST), "' today'", _two(_at_sql, _ODD_FIRST, _ODD_LAST))
_recovered("person_label", "PERSON", "label", "'contact person: '", f"lower({_two(_at, _ODD_FIRST, _ODD_LAST)})", "', by phone'", f"lower({_two(_at_sql, _ODD_FIRST, _ODD_LAST)})")
_recovered("person_gazetteer", "PERSON", "gazetteer", "'a note from '", _two(_at, _GIVEN, _LAST), "' on it'", _two(_at_sql, _GIVEN, _LAST))
_recovered("person_in_long_run", "PERSON", "gazetteer", "'see Alpha '", f"{_at(_GIVEN)} || ' Beta ' || {_at(_LAST, 7)}", "' Gamma now'", f"{_at_sql(_GIVEN)} || ' Beta ' || {_at_sql(_LAST, 7)}")
_recovered("org_suffix", "ORG", "legal_suffix", "'signed with the '", f"'Zed' || chr(CAST(97 + {_K} % 26 AS INT)) || ' Wire (India) Private Limited'", "', at once'")
_recovered("org_bank", "ORG", "legal_suffix", "'paid by '", f"'Zed' || chr(CAST(97 + {_K} % 26 AS INT)) || ' Savings Bank of Utopia'", "' at once'")
_recovered("address_pin", "ADDRESS", "pin_anchor", "'Old news. It lies at '", f"'Plot ' || CAST({_K} AS STRING) || ', Mill Road, Pune 411 ' || {_N(3)} || ', Maharashtra, India'", "'. More'")
_recovered("address_label", "ADDRESS", "address_label", "'address: '", f"'Flat ' || CAST({_K} AS STRING) || ', Old Town, East End'", "chr(10) || 'end'")

_CARD = "'4' || " + _DIGITS.replace(_N(8), _N(7))


@query(f"""WITH x AS (SELECT {_K}, {_CARD} || '0' AS d FROM customer), y AS (SELECT {_K}, d, CAST((10 - {_LUHN_SUM.format(odd=1)} % 10) % 10 AS STRING) AS c FROM x)
SELECT {_K}, 'CREDIT_CARD' AS type, 5 AS start, 21 AS "end", substr(d, 1, 15) || c AS text, 'credit_card' AS source FROM y""")
def recover_credit_card(spark, sf_dir):
    body = F.expr(_CARD)
    rows = read(spark, sf_dir, "customer").select(_K, F.concat(F.lit("card "), body, S.luhn_digit(body), F.lit(" used")).alias("text"))
    return span_rows(detect(rows), _K).select(_K, "type", "start", "end", "text", "source")


@query(f"SELECT {_K}, '+91 98765 ' || {_N(5)} AS trimmed FROM customer")
def long_phones_trimmed(spark, sf_dir):
    v = F.expr(f"'+91 98765 ' || {_N(5)} || ' ' || {_N(4, 7)}")
    return read(spark, sf_dir, "customer").select(_K, S.trim_phone(v).alias("trimmed"))


@query(f"SELECT {_K}, CASE WHEN {_K} % 2 = 0 THEN 1 ELSE 0 END AS n FROM customer")
def dates_behind_phone_labels(spark, sf_dir):
    """A date of birth counts behind its cue, not behind a telephone's label."""
    text = f"CASE WHEN {_K} % 2 = 0 THEN 'born on ' ELSE 'born; Tel: ' END || lpad(CAST(1 + {_K} % 12 AS STRING), 2, '0') || '-05-' || CAST(1950 + {_K} % 40 AS STRING)"
    rows = detect(_customers(spark, sf_dir, text))
    return rows.select(_K, F.size(F.filter("spans", lambda s: s["type"] == "DOB")).alias("n"))


@query("SELECT n_nationkey, n_name AS bare FROM nation")
def honorifics_stripped(spark, sf_dir):
    title = F.expr("element_at(array('Mr. ', 'Mrs ', 'Dr. ', 'Shri ', ''), int(n_nationkey % 5) + 1)")
    return read(spark, sf_dir, "nation").select("n_nationkey", names.strip_honorific(F.concat(title, "n_name")).alias("bare"))


@query(f"SELECT {_K}, 'code' AS source, 'ZZ-' || {_N(3)} AS text FROM customer")
def custom_recognizer(spark, sf_dir):
    """A recognizer of the caller's own, as a function from the text column to spans; the code is no entity that the rules know."""

    def codes(text):
        found = F.regexp_extract_all(text, F.lit(r"ZZ-\d{3}"), 0)
        return F.transform(found, lambda m: F.struct((F.instr(text, "ZZ-") - 1).alias("start"), (F.instr(text, "ZZ-") - 1 + F.length(m)).alias("end"), F.lit("LLPIN").alias("type"), m.alias("text"), F.lit(0.95).alias("score"), F.lit("code").alias("source")))

    rows = detect(_customers(spark, sf_dir, f"'code ZZ-' || {_N(3)} || ' there'"), extra=(codes,))
    return span_rows(rows, _K).select(_K, "source", "text")


@query(f"SELECT {_K}, 'PERSON' AS type, 3 AS start, 8 AS \"end\" FROM customer WHERE {_K} % 3 = 0 UNION ALL SELECT {_K}, 'PAN', 0, 5 FROM customer")
def score_and_type_filter(spark, sf_dir):
    """Spans under the least score and of types that are off go."""
    specs = (("0", "5", "PAN", "0.95"), ("3", "8", "PERSON", "0.80 - (c_custkey % 3) * 0.2"), ("9", "12", "ORG", "0.99"))
    rows = _made_spans(spark, sf_dir, *specs).select(_K, admissible(F.col("spans"), Config(min_score=0.7, disabled=("ORG",))).alias("spans"))
    return span_rows(rows, _K).select(_K, "type", "start", "end")


@query(f"SELECT {_K} AS doc_id, t.type, t.ord FROM customer, (VALUES ('ORG', 1), ('PERSON', 2), ('PERSON', 3), ('EMAIL', 4), ('PAN', 5)) AS t(type, ord)")
def order_of_detections(spark, sf_dir):
    """Organisations first, then people with more words before others, then mail, then identifiers."""
    made = "array(named_struct('t', 'PAN', 'x', 'A', 's', 0), named_struct('t', 'PERSON', 'x', 'One', 's', 1), named_struct('t', 'PERSON', 'x', 'One Two', 's', 9), named_struct('t', 'EMAIL', 'x', 'm', 's', 2), named_struct('t', 'ORG', 'x', 'O', 's', 99))"
    rows = read(spark, sf_dir, "customer").select(F.col(_K).alias("doc_id"), F.explode(F.expr(made)).alias("m")).select("doc_id", F.col("m.t").alias("type"), F.col("m.x").alias("text"), F.col("m.s").alias("start"), (F.col("m.s") + 1).alias("end"))
    return dictionary.ordered_detections(rows).select("doc_id", "type", "ord")


# --- the dictionary ------------------------------------------------------------------------------------------------------------


def _spans(rows: DataFrame, *made: tuple[str, str, str]) -> DataFrame:
    """Detections (doc_id, type, text, start, end) by expressions over customer."""
    array = ", ".join(f"named_struct('type', '{k}', 'text', {text}, 'start', int({at}), 'end', int({at}) + 5)" for k, text, at in made)
    return rows.select(F.col(_K).alias("doc_id"), F.explode(F.expr(f"array({array})")).alias("s")).select("doc_id", "s.*")


_BRAND = f"'Zed' || chr(CAST(97 + {_K} % 26 AS INT))"
_PERM = fakes.permuted(SALT)


@query(f"SELECT {_K} AS doc_id, translate(chr(CAST(65 + {_K} % 26 AS INT)), '{fakes.LETTERS}', '{_PERM}') || '. ' || translate('R', '{fakes.LETTERS}', '{_PERM}') || '.' AS initials, true AS surname_changed FROM customer")
def initials_follow_the_salt(spark, sf_dir):
    rows = _spans(read(spark, sf_dir, "customer"), ("PERSON", f"{_L(1)} || '. R. Mehta'", "0"))
    made = dictionary.build(rows, SALT)
    return made.select("doc_id", F.substring("pseudonym", 1, 5).alias("initials"), (F.element_at(F.split("pseudonym", " "), -1) != "Mehta").alias("surname_changed"))


@query(f"SELECT {_K} AS doc_id, 'ORG' AS type, {_BRAND} || ' Steel Private Limited' AS original, false AS part, true AS kept FROM customer UNION ALL SELECT {_K}, 'ORG', {_BRAND}, true, true FROM customer")
def org_short_forms(spark, sf_dir):
    """An organisation's pseudonym keeps its generic words; its distinctive run is an entry of its own with the same brand."""
    made = dictionary.build(_spans(read(spark, sf_dir, "customer"), ("ORG", f"{_BRAND} || ' Steel Private Limited'", "0")), SALT)
    brand = made.where("part").select("doc_id", F.col("pseudonym").alias("brand"))
    whole = F.when(F.col("part"), F.col("pseudonym")).otherwise(F.regexp_replace("pseudonym", " Steel Private Limited$", ""))
    return made.join(brand, "doc_id").select("doc_id", "type", "original", "part", (whole == F.col("brand")).alias("kept"))


@query(f"SELECT {_K} AS doc_id, 3 AS letters, true AS kept, true AS changed FROM customer")
def acronyms_stay_acronyms(spark, sf_dir):
    made = dictionary.build(_spans(read(spark, sf_dir, "customer"), ("ORG", f"{_L(1)} || 'Q' || {_L(3)} || ' Steel Private Limited'", "0")), SALT).where("not part")
    first = F.split("pseudonym", " ")[0]
    return made.select("doc_id", F.length(F.regexp_extract(first, "^[A-Z]+$", 0)).alias("letters"), F.col("pseudonym").endswith(" Steel Private Limited").alias("kept"), (first != F.split("original", " ")[0]).alias("changed"))


@query(f"""SELECT {_K} AS doc_id, h.type, CASE h.type WHEN 'DOMAIN' THEN 'zed' || chr(CAST(97 + {_K} % 26 AS INT)) || '.co.in' WHEN 'EMAIL' THEN 'info@zed' || chr(CAST(97 + {_K} % 26 AS INT)) || '.co.in'
ELSE 'https://www.zed' || chr(CAST(97 + {_K} % 26 AS INT)) || '.co.in/a?b=1' END AS original, true AS follows FROM customer, (VALUES ('DOMAIN'), ('EMAIL'), ('URL')) AS h(type)""")
def hosts_follow_the_brand(spark, sf_dir):
    """Mail, page and the bare host behind them change alike, by the brand of the organisation whose name the host has; mailboxes of
    roles, scheme, www and path stay."""
    host = "'zed' || chr(CAST(97 + c_custkey % 26 AS INT)) || '.co.in'"
    made = dictionary.build(_spans(read(spark, sf_dir, "customer"), ("ORG", f"{_BRAND} || ' Steel Limited'", "0"), ("EMAIL", f"'info@' || {host}", "50"), ("URL", f"'https://www.' || {host} || '/a?b=1'", "90")), SALT)
    brand = made.where("part").select("doc_id", F.concat(F.lower("pseudonym"), F.lit(".example.com")).alias("host"))
    want = F.when(F.col("type") == "EMAIL", F.concat(F.lit("info@"), "host")).when(F.col("type") == "URL", F.concat(F.lit("https://www."), "host", F.lit("/a?b=1"))).otherwise(F.col("host"))
    return made.where("type <> 'ORG'").join(brand, "doc_id").select("doc_id", "type", "original", (F.col("pseudonym") == want).alias("follows"))


@query(f"SELECT {_K} % 10 AS scope, count(DISTINCT {_K}) AS n_tokens, count(DISTINCT {_K}) AS n_fakes FROM customer GROUP BY ALL")
def names_dealt_without_repeats(spark, sf_dir):
    tokens = read(spark, sf_dir, "customer").select((F.col(_K) % 10).alias("scope"), F.concat(F.lit("token"), F.col(_K).cast("string")).alias("token"), F.lit("given").alias("role"))
    dealt = dictionary.deal(tokens, "scope", {"given": ("Ada", "Ben", "Cora", "Dan", "Edith")}, SALT)
    return dealt.groupBy("scope").agg(F.countDistinct("token").alias("n_tokens"), F.countDistinct("fake").alias("n_fakes"))


@query(f"SELECT {_K}, 3 AS commas, true AS pin, true AS country, true AS changed FROM customer")
def addresses_keep_their_shape(spark, sf_dir):
    v = F.expr(f"'Plot ' || CAST({_K} AS STRING) || ', Mill Road, Pune 411 ' || {_N(3)} || ', India'")
    made = fakes.fake_address(v, SALT)
    commas = F.length(F.regexp_replace(made, "[^,]", ""))
    return read(spark, sf_dir, "customer").select(_K, (commas - 1).cast("int").alias("commas"), made.rlike(r"9\d\d \d{3}").alias("pin"), made.endswith(", India").alias("country"), (made != v).alias("changed"))


_MAPPING = (("PERSON", "'Kiran Devi Mehta'", "'Ada May Birch'"), ("PAN", f"'ABCPK' || {_N(4)} || 'L'", f"'QRSPT' || {_N(4, 3, 1)} || 'U'"), ("ORG", "'Zed Steel Limited'", "'Lantern Steel Limited'"), ("DOMAIN", "'zed.co.in'", "'lantern.example.com'"))


def _mapping(spark, sf_dir) -> DataFrame:
    array = ", ".join(f"named_struct('ord', {i}, 'type', '{k}', 'original', {a}, 'pseudonym', {b}, 'part', false)" for i, (k, a, b) in enumerate(_MAPPING))
    parts = "named_struct('ord', 9, 'type', 'ORG', 'original', 'Zed', 'pseudonym', 'Lantern', 'part', true)"
    return read(spark, sf_dir, "customer").select(F.col(_K).alias("doc_id"), F.explode(F.expr(f"array({array}, {parts})")).alias("m")).select("doc_id", "m.*")


_P4, _F4 = _N(4), _N(4, 3, 1)
_BEFORE = f"'Mr KIRAN  DEVI MEHTA, Kiran Mehta, Mehta, a mehta; ABC PK-' || substr({_P4}, 1, 2) || ' ' || substr({_P4}, 3, 2) || ' L; Zed Steel Limited, Zed, zed, zed.co.in, x.zed.co.in'"
_AFTER = f"'Mr ADA MAY BIRCH, Ada Birch, Birch, a mehta; QRS PT-' || substr({_F4}, 1, 2) || ' ' || substr({_F4}, 3, 2) || ' U; Lantern Steel Limited, Lantern, zed, lantern.example.com, x.zed.co.in'"


@query(f"SELECT {_K} AS doc_id, {_AFTER} AS text, 7 AS n_replaced FROM customer")
def surfaces_rewritten(spark, sf_dir):
    """Names whole, first with last and by capitalised part; identifiers across separators; case kept; hosts only by themselves."""
    texts = _customers(spark, sf_dir, _BEFORE).withColumnRenamed(_K, "doc_id")
    return dictionary.rewrite(texts, _mapping(spark, sf_dir)).select("doc_id", "text", F.col("n_replaced").cast("int").alias("n_replaced"))


@query(f"SELECT DISTINCT type, original FROM (SELECT 'PAN' AS type, 'ABCPK' || {_N(4)} || 'L' AS original FROM customer UNION ALL VALUES ('PERSON', 'Kiran Devi Mehta'), ('ORG', 'Zed Steel Limited'), ('ORG', 'Zed'), ('DOMAIN', 'zed.co.in'))")
def mapping_export(spark, sf_dir):
    return tables.mapping_rows(_mapping(spark, sf_dir)).select("type", "original")


_SENTENCE = f"'By Mr. ' || {_at(_GIVEN)} || ' ' || {_at(_LAST, 7)} || ', PAN ABCPK' || {_N(4)} || 'L.'"


@query(f"SELECT 'Identifiers' AS class, count(*) AS measurable, CAST(0 AS BIGINT) AS leaked FROM customer UNION ALL SELECT 'Names', count(*), 0 FROM customer UNION ALL SELECT NULL, 2 * count(*), 0 FROM customer")
def self_audit_of_redaction(spark, sf_dir):
    """Whether any original of the dictionary is still in the rewritten text of its scope."""
    texts = _customers(spark, sf_dir, _SENTENCE).withColumnRenamed(_K, "doc_id")
    done = redact_texts(texts, Config(salt=SALT))
    return self_audit(done.mapping, texts, done.texts)


@query("SELECT CAST(2 * count(*) AS BIGINT) AS replacements, count(*) AS n_pan, count(*) AS n_person FROM customer")
def report_totals(spark, sf_dir):
    texts = _customers(spark, sf_dir, _SENTENCE).withColumnRenamed(_K, "doc_id")
    report = redact_texts(texts, Config(salt=SALT)).report
    return report.select("replacements", F.col("detections_by_type")["PAN"].alias("n_pan"), F.col("detections_by_type")["PERSON"].alias("n_person"))


# --- counts and evaluation -----------------------------------------------------------------------------------------------------


def _named_spans(spark, sf_dir) -> DataFrame:
    return _spans(read(spark, sf_dir, "customer"), ("PERSON", "'Same Name'", "0"), ("PERSON", "'same  NAME'", "20"), ("PAN", f"'ABCPK' || {_N(4)} || 'L'", "40"))


@query(f"""WITH r AS (SELECT 'Names' AS class, 'PERSON' AS type, 'same name' AS v FROM customer UNION ALL SELECT 'Names', 'PERSON', 'same name' FROM customer UNION ALL SELECT 'Identifiers', 'PAN', {_N(4)} FROM customer)
SELECT class, type, count(*) AS n, count(DISTINCT v) AS n_unique FROM r GROUP BY ROLLUP (class, type)""")
def counts_by_class(spark, sf_dir):
    return audit.counts_by_class(_named_spans(spark, sf_dir))


@query("SELECT class, n, place FROM (VALUES ('Names', 1), ('Identifiers', 2)) AS t(class, place), (SELECT count(*) AS n FROM customer) WHERE place = 2 UNION ALL SELECT 'Names', 2 * count(*), 1 FROM customer")
def class_series(spark, sf_dir):
    """Detections by class, the commonest first."""
    return audit.class_series(_named_spans(spark, sf_dir)).select("class", "n", "place")


@query(f"SELECT {_K} AS doc_id, 'Same Name' AS text FROM customer UNION ALL SELECT {_K}, 'ABCPK' || {_N(4)} || 'L' FROM customer")
def unique_detections(spark, sf_dir):
    return audit.unique_detections(_named_spans(spark, sf_dir)).select("doc_id", "text")


_LOOSE = """
WITH c AS (SELECT c_custkey % 5 AS m FROM customer), k AS (SELECT class, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (
  SELECT 'Names' AS class, CASE WHEN m IN (0, 1, 2) THEN 1 ELSE 0 END AS tp, CASE WHEN m = 4 THEN 1 ELSE 0 END AS fp, CASE WHEN m IN (3, 4) THEN 1 ELSE 0 END AS fn FROM c
  UNION ALL SELECT 'Addresses', 1, 0, 0 FROM c) GROUP BY ROLLUP (class)),
r AS (SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(tp / (tp + fp + fn), 4) AS csi FROM k)
SELECT class, tp, fp, fn, precision, recall, round(2 * precision * recall / (precision + recall), 4) AS f1, csi FROM r"""


@query(_LOOSE)
def metrics_lenient(spark, sf_dir):
    """Names found whole (0), as a part (1) or with more around (2), not at all (3), as something else (4); addresses in two pieces."""
    c = read(spark, sf_dir, "customer")
    key = F.concat(F.lit("n"), F.sha2(F.col(_K).cast("string"), 256).substr(1, 24))
    m = F.col(_K) % 5
    whole = F.concat(key, F.lit(" middle last"))
    told = F.when(m == 0, whole).when(m == 1, F.concat(key, F.lit(" middle"))).when(m == 2, F.concat(F.lit("the "), whole)).when(m == 4, F.concat(F.lit("else "), F.sha2(F.concat(F.lit("x"), F.col(_K).cast("string")), 256)))
    truth = c.select((F.col(_K) * 2).alias("id"), F.lit("Names").alias("class"), whole.alias("value"), F.lit(True).alias("detect"))
    found = c.select((F.col(_K) * 3).alias("id"), F.lit("Names").alias("class"), told.alias("value")).where("value is not null")
    spot = F.concat(F.lit("plot "), key, F.lit(" mill road "), key, F.lit("b"))
    truth = truth.union(c.select(F.col(_K) * 2 + 1, F.lit("Addresses"), spot, F.lit(True)))
    pieces = c.select(F.col(_K) * 3 + 1, F.lit("Addresses"), F.concat(F.lit("plot "), key)).union(c.select(F.col(_K) * 3 + 2, F.lit("Addresses"), F.concat(F.lit("mill road "), key, F.lit("b x"))))
    return audit.score(found.union(pieces), truth, lenient=True)


@query(f"SELECT {_K} AS t_id, CASE WHEN {_K} % 3 = 0 THEN 2 ELSE 1 END AS n_pieces FROM customer")
def address_token_coverage(spark, sf_dir):
    """How many finds have half of their words in each address."""
    c = read(spark, sf_dir, "customer")
    key = F.concat(F.lit("k"), F.col(_K).cast("string"))
    truth = c.select(F.col(_K).alias("t_id"), F.lit("Addresses").alias("class"), F.concat(key, F.lit("a "), key, F.lit("b "), key, F.lit("c")).alias("t"))
    found = c.select(F.col(_K).alias("f_id"), F.lit("Addresses").alias("class"), F.concat(key, F.lit("a "), key, F.lit("b")).alias("f"))
    found = found.union(c.select(-F.col(_K), F.lit("Addresses"), F.when(F.col(_K) % 3 == 0, F.concat(key, F.lit("c zz"))).otherwise(F.concat(key, F.lit("c yy zz")))))
    return audit._pieces(found, truth).groupBy("t_id").agg(F.count("*").cast("int").alias("n_pieces"))


@query(f"SELECT {_K} AS doc_id, 'vexley' AS word FROM customer WHERE {_K} % 4 = 0")
def partial_token_leaks(spark, sf_dir):
    values = _spans(read(spark, sf_dir, "customer"), ("PERSON", "'Quorra Vexley'", "0"), ("ORG", "'Vexley Steel Ltd'", "30")).select("doc_id", "type", F.col("text").alias("original"))
    after = _customers(spark, sf_dir, f"CASE WHEN {_K} % 4 = 0 THEN 'the VEXLEY steel' ELSE 'the steel of it' END").withColumnRenamed(_K, "doc_id")
    return audit.partial_leaks(values, after, ["steel"])


# --- scanned images ------------------------------------------------------------------------------------------------------------


def _card(spark, sf_dir) -> DataFrame:
    """A tax card for each even customer, an identity card for each odd one, as recognised words."""
    word = lambda line, x, y, w, t: f"named_struct('l', {line}, 'x', {x}, 'y', {y}, 'w', {w}, 't', {t})"
    tax = [(0, 20, 10, 60, "'INCOME'"), (0, 90, 10, 40, "'TAX'"), (1, 200, 60, 90, "'Permanent'"), (1, 300, 60, 70, "'Account'"), (2, 30, 160, 50, "'Name'"), (3, 30, 190, 70, "'QUORRA'"), (3, 110, 190, 60, "'ZORGO'")]
    other = [(0, 20, 10, 100, "'Aadhaar'"), (1, 200, 60, 80, "'Quorra'"), (1, 300, 60, 60, "'Zorgo'"), (2, 200, 90, 40, "'DOB:'"), (2, 250, 90, 90, f"'12/05/' || CAST(1950 + {_K} % 40 AS STRING)"), (3, 200, 120, 50, "'Male'"), (4, 20, 200, 80, "'Address:'"), (4, 110, 200, 40, "'S/O'"), (4, 160, 200, 90, "'Vexley'"), (4, 260, 200, 60, "'Zorgo,'"), (4, 330, 200, 40, "'Plot'"), (4, 380, 200, 20, "'7,'"), (5, 20, 220, 60, "'Pune'"), (5, 90, 220, 80, "'411001'"), (6, 20, 240, 60, "'end'")]
    rows = read(spark, sf_dir, "customer").select(F.col(_K).alias("k"), F.explode(F.expr(f"CASE WHEN {_K} % 2 = 0 THEN array({', '.join(word(*w) for w in tax)}) ELSE array({', '.join(word(*w) for w in other)}) END")).alias("w"))
    return rows.select(F.col("k").cast("string").alias("image"), F.lit(0).alias("block"), F.lit(0).alias("par"), F.col("w.l").alias("line"), F.col("w.t").alias("text"), F.col("w.x").alias("left"), F.col("w.y").alias("top"), F.col("w.w").alias("width"), F.lit(20).alias("height"), F.lit(90.0).alias("conf"))


@query(f"SELECT CAST({_K} AS STRING) AS image, true AS is_id FROM customer")
def id_documents(spark, sf_dir):
    return ocr.id_document(ocr.lines(_card(spark, sf_dir)))


@query(f"""SELECT CAST({_K} AS STRING) AS image, 3 AS line_no, 0 AS start, 12 AS "end", 'PERSON' AS type, 'QUORRA ZORGO' AS text FROM customer WHERE {_K} % 2 = 0
UNION ALL SELECT CAST({_K} AS STRING), 2, 5, 15, 'DOB', '12/05/' || CAST(1950 + {_K} % 40 AS STRING) FROM customer WHERE {_K} % 2 = 1
UNION ALL SELECT CAST({_K} AS STRING), 4, 13, 25, 'PERSON', 'Vexley Zorgo' FROM customer WHERE {_K} % 2 = 1
UNION ALL SELECT CAST({_K} AS STRING), 4, 27, 34, 'ADDRESS', 'Plot 7,' FROM customer WHERE {_K} % 2 = 1
UNION ALL SELECT CAST({_K} AS STRING), 5, 0, 11, 'ADDRESS', 'Pune 411001' FROM customer WHERE {_K} % 2 = 1""")
def image_hits(spark, sf_dir):
    """Lines detected with what identity documents allow, card rules, address blocks with the relative they name; deduped."""
    return ocr.all_hits(ocr.lines(_card(spark, sf_dir))).select("image", "line_no", "start", "end", "type", "text")


@query(f"""SELECT CAST({_K} AS STRING) AS image, 22 AS x0, 34 AS y0, 194 AS x1, 156 AS y1, 'pan_layout' AS source FROM customer WHERE {_K} % 2 = 0
UNION ALL SELECT CAST({_K} AS STRING), 92, 40, 194, 160, 'aadhaar_layout' FROM customer WHERE {_K} % 2 = 1""")
def portraits_from_layout(spark, sf_dir):
    images = read(spark, sf_dir, "customer").select(F.col(_K).cast("string").alias("image"), F.lit(500).alias("width"), F.lit(300).alias("height"))
    return ocr.portrait_from_layout(ocr.lines(_card(spark, sf_dir)), images)


@query(f"SELECT CAST({_K} AS STRING) AS image, 50 AS x0, 62 AS y0, 198 AS x1, 258 AS y1 FROM customer")
def portraits_from_faces(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col(_K).cast("string").alias("image"))
    faces = c.select("image", F.lit(91).alias("x0"), F.lit(100).alias("y0"), F.lit(180).alias("x1"), F.lit(200).alias("y1"))
    words = c.select("image", F.explode(F.array(F.struct(F.lit(200).alias("left"), F.lit(120).alias("top")), F.struct(F.lit(110).alias("left"), F.lit(260).alias("top")), F.struct(F.lit(110).alias("left"), F.lit(50).alias("top")))).alias("w")).select("image", "w.*", F.lit(20).alias("width"), F.lit(10).alias("height"))
    return ocr.portrait_from_face(faces, words, c.withColumn("width", F.lit(400)).withColumn("height", F.lit(400)))


@query(f"SELECT CAST({_K} AS STRING) AS image, CASE WHEN {_K} % 2 = 0 THEN '0101010101010101' ELSE '0101000001010000' END AS painted FROM customer")
def images_painted(spark, sf_dir):
    """Boxes black in the rasters of odd customers: columns 2 and 3 of two rows."""
    c = read(spark, sf_dir, "customer").select(F.col(_K).alias("k"), F.col(_K).cast("string").alias("image"))
    images = c.select("image", F.lit(4).alias("width"), F.lit(2).alias("height"), F.lit(1).alias("channels"), F.unhex(F.lit("01" * 8)).alias("raster"))
    boxes = c.where("k % 2 = 1").select("image", F.lit(2).alias("x0"), F.lit(0).alias("y0"), F.lit(4).alias("x1"), F.lit(9).alias("y1"))
    return ocr.paint_images(images, boxes).select("image", F.hex("raster").alias("painted"))


@query(f"SELECT {_K} AS doc_id, true AS same FROM customer")
def images_share_the_dictionary(spark, sf_dir):
    """A name in an image gets the pseudonym that it has in the text of its document."""
    texts = _customers(spark, sf_dir, _SENTENCE).withColumnRenamed(_K, "doc_id")
    who = f"{_at(_GIVEN)} || ' ' || {_at(_LAST, 7)}"
    hits = read(spark, sf_dir, "customer").select(F.col(_K).alias("doc_id"), F.lit(0).alias("line_no"), F.lit(0).alias("start"), F.length(F.expr(who)).alias("end"), F.lit("PERSON").alias("type"), F.expr(who).alias("text"), F.lit("id_caps_line").alias("source"))
    done = redact_texts(texts, Config(salt=SALT), hits=hits)
    return shown(hits, done.mapping).join(done.texts.withColumnRenamed("text", "_t"), "doc_id").select("doc_id", (F.contains(F.col("_t"), F.col("pseudonym")) & (F.col("pseudonym") != F.col("text"))).alias("same"))


# --- tables and packages -------------------------------------------------------------------------------------------------------


@query(f"SELECT {_K} AS table_id, 'DIN' AS type, lpad(CAST({_K} AS STRING), 8, '0') AS text, 'table_key' AS source FROM customer UNION ALL SELECT {_K}, 'PERSON', {_two(_at_sql, _GIVEN, _LAST)}, 'table_key' FROM customer")
def table_key_values(spark, sf_dir):
    """Values beside labelled first cells, also in the first row; a role and a word of the header are no names."""
    cells = f"array(named_struct('r', 0, 'c', 0, 't', 'Name'), named_struct('r', 0, 'c', 1, 't', {_two(_at, _GIVEN, _LAST)}), named_struct('r', 1, 'c', 0, 't', 'DIN'), named_struct('r', 1, 'c', 1, 't', lpad(string(c_custkey), 8, '0')), named_struct('r', 2, 'c', 0, 't', 'Full name'), named_struct('r', 2, 'c', 1, 't', 'Managing Director'))"
    grid = read(spark, sf_dir, "customer").select(F.col(_K).alias("table_id"), F.explode(F.expr(cells)).alias("x")).select("table_id", F.col("x.r").alias("row_no"), F.col("x.c").alias("col_no"), F.col("x.t").alias("text"))
    return names.table_values(grid).where("source = 'table_key'").select("table_id", "type", "text", "source")


@query("SELECT t.v AS value, t.kind, t.ok FROM (VALUES ('Kiran Mehta', 'PERSON', true), ('Managing Director', 'PERSON', false), ('Company Limited', 'ORG', false), ('Zed Steel Limited', 'ORG', true), ('ab', 'PAN', false), ('the board', 'ORG', false)) AS t(v, kind, ok), nation")
def plausible_values(spark, sf_dir):
    made = "array(named_struct('v', 'Kiran Mehta', 'k', 'PERSON'), named_struct('v', 'Managing Director', 'k', 'PERSON'), named_struct('v', 'Company Limited', 'k', 'ORG'), named_struct('v', 'Zed Steel Limited', 'k', 'ORG'), named_struct('v', 'ab', 'k', 'PAN'), named_struct('v', 'the board', 'k', 'ORG'))"
    rows = read(spark, sf_dir, "nation").select(F.explode(F.expr(made)).alias("x")).select(F.col("x.v").alias("value"), F.col("x.k").alias("kind"))
    return rows.withColumn("ok", names.plausible(F.col("kind"), F.col("value")))


_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_TYPES = '<Types><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'


def _package(name: str) -> bytes:
    """A small package about a nation: a name over several runs, a tab, a deletion, an attribute, a table, a link, an image."""
    r = lambda t, props="": f'<w:r>{props}<w:t xml:space="preserve">{t}</w:t></w:r>'
    cell = lambda t: f"<w:tc><w:p>{r(t)}</w:p></w:tc>"
    body = f"<w:p>{r('By Kir')}{r('an Mehta', '<w:rPr><w:b/></w:rPr>')}{r(f' of {name}')}</w:p><w:p><w:del w:author=\"Kiran Mehta\"><w:r><w:delText>Kiran Mehta</w:delText></w:r></w:del>{r('left')}<w:r><w:tab/></w:r>{r('right')}</w:p><w:tbl><w:tr>{cell('Name')}{cell('Nation')}</w:tr><w:tr>{cell('Kiran Mehta')}{cell(name)}</w:tr></w:tbl><w:p><w:drawing descr=\"Kiran Mehta at work\"/></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {_NS}/>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="mailto:kiran@zed.co.in" TargetMode="External"/><Relationship Id="r2" Target="styles.xml"/></Relationships>')
        z.writestr("word/media/a.png", b"\x89PNG")
    return out.getvalue()


def _packages(spark, sf_dir) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": [f"{k}.docx" for k in f["n_nationkey"]], "content": [_package(n) for n in f["n_name"]]})

    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(run, "doc_id string, content binary")


_DOC = "CAST(n_nationkey AS STRING) || '.docx' AS doc_id"
_PARTS = "'word/document.xml' AS part"


@query(f"SELECT {_DOC}, {_PARTS}, u.unit_id, replace(u.text, '@', n_name) AS text FROM nation, (VALUES (0, 'By Kiran Mehta of @'), (1, 'left' || chr(9) || 'right'), (2, 'Name'), (3, 'Nation'), (4, 'Kiran Mehta'), (5, '@'), (6, '')) AS u(unit_id, text)")
def package_paragraphs(spark, sf_dir):
    return ooxml.paragraphs(_packages(spark, sf_dir))


@query(f"SELECT {_DOC}, {_PARTS}, 'By Kiran Mehta of ' || n_name || chr(10) || 'left' || chr(9) || 'right' || chr(10) || 'Name' || chr(10) || 'Nation' || chr(10) || 'Kiran Mehta' || chr(10) || n_name || chr(10) AS text FROM nation")
def package_part_texts(spark, sf_dir):
    return ooxml.part_texts(ooxml.paragraphs(_packages(spark, sf_dir)))


@query(f"SELECT {_DOC}, u.row_no, u.col_no, replace(u.text, '@', n_name) AS text FROM nation, (VALUES (0, 0, 'Name'), (0, 1, 'Nation'), (1, 0, 'Kiran Mehta'), (1, 1, '@')) AS u(row_no, col_no, text)")
def package_tables(spark, sf_dir):
    return ooxml.grid(_packages(spark, sf_dir)).select("doc_id", "row_no", "col_no", "text")


@query(f"SELECT {_DOC}, 'mailto:kiran@zed.co.in' AS target, 'word/media/a.png' AS image, 5 AS parts_ok FROM nation")
def package_links_images_integrity(spark, sf_dir):
    packages = _packages(spark, sf_dir)
    whole = ooxml.integrity(packages).where("ok").groupBy("doc_id").agg(F.count("*").cast("int").alias("parts_ok"))
    return ooxml.links(packages).select("doc_id", "target").join(ooxml.images(packages).select("doc_id", F.col("part").alias("image")), "doc_id").join(whole, "doc_id")


def _rewritten_packages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    packages = _packages(spark, sf_dir)
    one = F.explode(F.expr("array(named_struct('ord', 0, 'type', 'PERSON', 'original', 'Kiran Mehta', 'pseudonym', 'Ada Birch', 'part', false), named_struct('ord', 1, 'type', 'EMAIL', 'original', 'kiran@zed.co.in', 'pseudonym', 'ada@example.com', 'part', false))")).alias("m")
    return packages, ooxml.rewrite(packages, packages.select("doc_id", one).select("doc_id", "m.*"))


@query(f"""SELECT {_DOC}, h.kind, replace(h.text, '%', n_name) AS text FROM nation, (VALUES ('text', 'By Ada Birch of %'), ('text', 'left' || chr(9) || 'right'), ('text', 'Name'), ('text', 'Nation'), ('text', 'Ada Birch'), ('text', '%'),
('text', 'Ada Birch'), ('attribute', 'Redacted'), ('attribute', 'preserve'), ('attribute', 'Ada Birch at work'), ('link', 'mailto:ada@example.com')) AS h(kind, text)""")
def package_rewritten(spark, sf_dir):
    """What is in the rewritten packages: paragraphs over several runs, deleted text, attributes shown and redacted, links."""
    _, done = _rewritten_packages(spark, sf_dir)
    rows = ooxml.harvest(done).select("doc_id", "kind", "text")
    return rows.where("text <> 'preserve'").unionByName(rows.where("text = 'preserve'").distinct())


@query(f"SELECT {_DOC}, CAST(5 AS BIGINT) AS n_replaced, CAST(0 AS BIGINT) AS n_changes FROM nation")
def package_structure(spark, sf_dir):
    """Rewriting leaves runs, paragraphs, tables and formats as they were."""
    packages, done = _rewritten_packages(spark, sf_dir)
    changed = audit.structure_changes(ooxml.structure(packages), ooxml.structure(done)).groupBy("doc_id").agg(F.count("*").alias("n"))
    return done.select("doc_id", "n_replaced").join(changed, "doc_id", "left").select("doc_id", "n_replaced", F.coalesce("n", F.lit(0)).cast("long").alias("n_changes"))
