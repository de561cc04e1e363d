"""The registered queries over the driver's tables and their SQL.

Most hold text made from table columns: the SQL side never detects anything, it returns the embedded value and where it was put.
Expressions that both engines read alike are written once and used on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fakes, scalars as S
from ..operators import audit, dictionary, names, ocr
from ..operators.patterns import BY_NAME, RULES, all_pattern_spans
from ..operators.resolve import admissible, detect, greedy, span_rows
from ..types import SPANS, Config

SALT = "registered-queries"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- detection on texts made from customer -------------------------------------------------------------------------------------

_K = "c_custkey"
_L = lambda m, a=0: f"chr(CAST(65 + ({_K} * {m} + {a}) % 26 AS INT))"
_N = lambda n, m=1, a=0: f"lpad(CAST(({_K} * {m} + {a}) % {10**n} AS STRING), {n}, '0')"

#: name -> (rule, type, text before, value, text after); both engines evaluate these as SQL.
EMBEDDED: dict[str, tuple[str, str, str, str]] = {
    "email": ("EMAIL", "'écrire à '", f"'user.' || {_N(5)} || '@mail' || {_N(2)} || '.example.org'", "', merci'"),
    "url": ("URL", "'voir ('", f"'https://site' || {_N(4)} || '.example.org/a?b=' || {_N(3)}", "'), puis 1.2.3'"),
    "gstin": ("GSTIN", "'GST '", f"lpad(CAST(1 + {_K} % 37 AS STRING), 2, '0') || {_L(1)} || 'BC' || 'P' || {_L(3)} || {_N(4)} || 'K' || '1Z' || {_L(5)}", "' registered'"),
    "pan": ("PAN", "'Número: '", f"{_L(1)} || {_L(3)} || 'C' || 'P' || {_L(5)} || {_N(4)} || {_L(7)}", "' of 1,84,89,583 shares'"),
    "cin": ("CIN", "'CIN '", f"'U' || {_N(5)} || 'MH' || CAST(1950 + {_K} % 70 AS STRING) || 'PLC' || {_N(6, 7)}", "'. ISIN INE' || 'x'"),
    "llpin": ("LLPIN", "'its LLPIN is '", f"{_L(1)} || 'B' || {_L(3)} || '-' || {_N(4)}", "' today'"),
    "din": ("DIN", "'Director (DIN No.: '", f"lpad(CAST({_K} AS STRING), 8, '0')", "') of 12345678 units'"),
    "sebi": ("SEBI_REG", "'Manager '", f"'INM' || {_N(9, 7)}", "' lead'"),
    "ifsc": ("IFSC", "'branch '", f"'ABC' || {_L(1)} || '0' || {_N(6)}", "' ok'"),
    "passport": ("PASSPORT", "'passport no '", f"{_L(1)} || CAST(1 + {_K} % 9 AS STRING) || {_N(6)}", "' valid'"),
    "aadhaar": ("AADHAAR", "'id '", f"CAST(2 + {_K} % 8 AS STRING) || {_N(3)} || ' ' || {_N(4, 7)} || ' ' || {_N(4, 3)}", "' done'"),
    "bank_account": ("BANK_ACCOUNT", "'Account No. '", f"'91' || {_N(9, 7)}", "' at the branch'"),
    "ssn": ("SSN", "'ssn '", f"'1' || {_N(2)} || '-' || lpad(CAST(1 + {_K} % 99 AS STRING), 2, '0') || '-' || lpad(CAST(1 + {_K} % 9999 AS STRING), 4, '0')", "' issued'"),
    "ipv4": ("IP_ADDRESS", "'from '", f"'10.' || CAST({_K} % 256 AS STRING) || '.' || CAST({_K} * 7 % 256 AS STRING) || '.' || CAST(10 + {_K} % 240 AS STRING)", "' version 1.2.3.4.5'"),
    "ipv6": ("IP_ADDRESS", "'host '", f"'2001:db8:0:1:2:3:' || {_N(4)} || ':a' || CAST({_K} % 10 AS STRING)", "' up'"),
    "phone_intl": ("PHONE", "'Tél: '", f"'+91 ' || CAST(6 + {_K} % 4 AS STRING) || {_N(4)} || ' ' || {_N(5, 7)}", "' soir'"),
    "phone_tollfree": ("PHONE", "'call '", f"'1800 ' || {_N(3)} || ' ' || {_N(4, 7)}", "' now'"),
    "phone_mobile": ("PHONE", "'call '", f"CAST(6 + {_K} % 4 AS STRING) || {_N(4)} || ' ' || {_N(5, 7)}", "' now'"),
    "phone_334": ("PHONE", "'call '", f"CAST(6 + {_K} % 4 AS STRING) || {_N(2)} || '-' || {_N(3, 7)} || '-' || {_N(4, 3)}", "' now'"),
    "phone_landline": ("PHONE", "'office '", f"'022-' || lpad(CAST(100 + {_K} % 900 AS STRING), 3, '0') || ' ' || {_N(4, 7)}", "' open'"),
    "phone_ctx": ("PHONE", "'Tel '", f"'{{}}' || '27' || ' ' || {_N(6, 7)}".replace("'{}' || ", ""), "' open'"),
    "dob": ("DOB", "'born on '", f"CAST(1 + {_K} % 28 AS STRING) || ' March ' || CAST(1930 + {_K} % 80 AS STRING)", "', not 31/13/1990'"),
}


def _recover(name: str) -> None:
    kind, lead, value, tail = EMBEDDED[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read(spark, sf_dir, "customer").select(_K, F.expr(f"({lead}) || ({value}) || ({tail})").alias("text"))
        return span_rows(detect(rows), _K).select(_K, "type", "start", "end", "text")

    run.__name__ = f"recover_{name}"
    lead_sql, value_sql = lead, value
    QUERIES[run.__name__] = run
    SQL[run.__name__] = f"""SELECT {_K}, '{kind}' AS type, CAST(length({lead_sql}) AS INT) AS start, CAST(length({lead_sql}) + length({value_sql}) AS INT) AS "end", {value_sql} AS text FROM customer"""


for _name in EMBEDDED:
    _recover(_name)

# --- checksums -----------------------------------------------------------------------------------------------------------------

_DIGITS = f"{_N(8)} || {_N(7, 7, 3)}"
_LUHN_SUM = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = {odd} THEN CASE WHEN CAST(d[i] AS INT) > 4 THEN CAST(d[i] AS INT) * 2 - 9 ELSE CAST(d[i] AS INT) * 2 END ELSE CAST(d[i] AS INT) END))"


@query(f"WITH x AS (SELECT {_K}, {_DIGITS} AS d FROM customer) SELECT {_K}, {_LUHN_SUM.format(odd=1)} % 10 = 0 AS ok, CAST((10 - {_LUHN_SUM.format(odd=0)} % 10) % 10 AS STRING) AS digit FROM x")
def luhn_audit(spark, sf_dir):
    d = F.expr(_DIGITS)
    return read(spark, sf_dir, "customer").select(_K, S.luhn_ok(d).alias("ok"), S.luhn_digit(d).alias("digit"))


_ARR = lambda t: "[" + ", ".join("[" + ",".join(r) + "]" for r in t) + "]"
_VERHOEFF = f"""
WITH x AS (SELECT {_K}, {_N(11, 7919)} AS d FROM customer),
f AS (SELECT {_K}, d, list_reduce(list_prepend(0, list_transform(range(1, length(d) + 1), lambda i: {_ARR(S.VERHOEFF_P)}[i % 8 + 1][CAST(d[length(d) - i + 1] AS INT) + 1])), lambda a, b: {_ARR(S.VERHOEFF_D)}[a + 1][b + 1]) AS c FROM x)
SELECT {_K}, substr('{S.VERHOEFF_INV}', c + 1, 1) AS digit, true AS ok FROM f"""


@query(_VERHOEFF)
def verhoeff_roundtrip(spark, sf_dir):
    d = F.expr(_N(11, 7919))
    digit = S.verhoeff_digit(d)
    return read(spark, sf_dir, "customer").select(_K, digit.alias("digit"), S.verhoeff_ok(F.concat(d, digit)).alias("ok"))


def _hmac_sql(value: str, salt: str = SALT) -> str:
    inner, outer = fakes._pads(salt)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


@query(f"SELECT {_K}, {_hmac_sql('c_name')} AS token FROM customer")
def hmac_tokens_customer(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(_K, fakes.hmac_hex(F.col("c_name"), SALT).alias("token"))


@query("SELECT page_id, regexp_replace(regexp_extract(regexp_replace(lower(url), '^[a-z]+://', ''), '^[^/?#:]*'), '^www[.]', '') AS host, length(url) > 6 AS usable FROM pages")
def host_of_pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", S.host_of(F.col("url")).alias("host"), S.trim_url(F.col("url")).isNotNull().alias("usable"))


_SCALAR_SQL = """
SELECT c_custkey, lower(trim(regexp_replace('  ' || c_name || '  X ', '\\s+', ' ', 'g'))) AS norm, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS akey,
       upper('Acme') AS cased, lower('Acme') AS lowered, levenshtein(c_name, c_name || substr('xyz', 1, CAST(c_custkey % 3 AS INT))) <= 1 AS near,
       list_sort(list_distinct(regexp_extract_all(lower(c_name), '[a-z0-9]+'))) AS words
FROM customer"""


@query(_SCALAR_SQL)
def text_scalars(spark, sf_dir):
    n = F.col("c_name")
    return read(spark, sf_dir, "customer").select(
        _K, S.norm(F.concat(F.lit("  "), n, F.lit("  X "))).alias("norm"), S.alnum_key(n).alias("akey"),
        S.match_case(F.upper(n), F.lit("Acme")).alias("cased"), S.match_case(F.lower(n), F.lit("Acme")).alias("lowered"),
        S.within_one_edit(n, F.concat(n, F.expr("substr('xyz', 1, int(c_custkey % 3))"))).alias("near"), F.sort_array(S.tokens(n)).alias("words"),
    )


# --- documents -----------------------------------------------------------------------------------------------------------------


@query()
def detect_documents(spark, sf_dir):
    rows = detect(read(spark, sf_dir, "documents").select("doc_id", "text"), extra=(names.free_text_spans(),))
    return span_rows(rows, "doc_id").select("doc_id", "seq", "start", "end", "type", "text", "score", "source")


def _counted(kind: str, rule: str, sql_pattern: str, guard: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..operators.patterns import pattern_spans

        rows = read(spark, sf_dir, "documents").select("doc_id", pattern_spans(F.col("text"), BY_NAME[rule]).alias("s"))
        return rows.where(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("s", lambda x: x["text"])), " ").alias("found"))

    run.__name__ = f"detect_{rule}_documents"
    QUERIES[run.__name__] = run
    SQL[run.__name__] = f"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{sql_pattern}', 2)) AS v FROM documents)
SELECT doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY v) AS found FROM m WHERE {guard} GROUP BY doc_id"""


_counted("EMAIL", "email", "(^|[^A-Za-z0-9_.+%-])([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,})", "true")
_counted("IP_ADDRESS", "ipv4", "(^|[^0-9.])([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})", "len(list_filter(string_split(v, '.'), lambda x: CAST(x AS INT) > 255 OR (length(x) > 1 AND x[1] = '0'))) = 0 AND len(list_filter(string_split(v, '.'), lambda x: CAST(x AS INT) > 9)) > 0")


@query()
def entity_counts_rollup(spark, sf_dir):
    return audit.counts_by_class(span_rows(detect(read(spark, sf_dir, "documents").select("doc_id", "text"), extra=(names.free_text_spans(),)), "doc_id"))


@query()
def redact_documents(spark, sf_dir):
    from .redact import redact_texts

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = redact_texts(docs, Config(salt=SALT))
    return done.texts.select("doc_id", "text", "n_replaced")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE NOT regexp_matches(text, '[0-9@:]')")
def redact_leaves_plain_documents(spark, sf_dir):
    from .redact import redact_texts

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = redact_texts(docs, Config(salt=SALT)).texts
    plain = docs.where(~F.col("text").rlike("[0-9@:]")).withColumnRenamed("text", "was")
    return done.join(plain, "doc_id").where("text = was and n_replaced = 0").select("doc_id", F.length("text").cast("long").alias("n"))


# --- resolution ----------------------------------------------------------------------------------------------------------------


def _made_spans(spark, sf_dir, *specs: tuple[str, str, str, str]) -> DataFrame:
    made = [F.expr(f"named_struct('start', int({s}), 'end', int({e}), 'type', '{t}', 'text', 'x', 'score', double({sc}), 'source', 's{i}')") for i, (s, e, t, sc) in enumerate(specs)]
    return read(spark, sf_dir, "customer").select(_K, F.array(*made).cast(SPANS).alias("spans"))


_SPECS = (("c_custkey % 7", "c_custkey % 7 + 5", "PAN", "0.95"), ("c_custkey % 5 + 2", "c_custkey % 5 + 12", "ADDRESS", "0.82"), ("c_custkey % 11", "c_custkey % 11 + 6", "ORG", "0.85"), ("3", "9 + c_custkey % 4", "PERSON", "0.8"))


def _greedy_sql() -> str:
    cand = " UNION ALL ".join(f"SELECT {_K}, {i} AS i, CAST({s} AS INT) AS s, CAST({e} AS INT) AS e, '{t}' AS type, CASE WHEN {sc} >= 0.9 THEN 0 WHEN '{t}' = 'ADDRESS' THEN 1 ELSE 2 END AS tier, {sc} AS score FROM customer" for i, (s, e, t, sc) in enumerate(_SPECS))
    return f"""
WITH RECURSIVE c AS ({cand}), o AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY tier, -score, s - e, s, i) AS n FROM c),
r AS (SELECT {_K}, n, [{{'s': s, 'e': e, 't': type}}] AS kept FROM o WHERE n = 1
      UNION ALL SELECT o.{_K}, o.n, CASE WHEN len(list_filter(kept, lambda k: k.s < o.e AND o.s < k.e)) > 0 THEN kept ELSE list_append(kept, {{'s': o.s, 'e': o.e, 't': o.type}}) END
      FROM r JOIN o ON o.{_K} = r.{_K} AND o.n = r.n + 1),
k AS (SELECT {_K}, unnest(kept) AS x FROM r WHERE n = {len(_SPECS)})
SELECT {_K}, x.s AS start, x.e AS "end", x.t AS type FROM k"""


@query(_greedy_sql())
def greedy_resolution(spark, sf_dir):
    return span_rows(_made_spans(spark, sf_dir, *_SPECS).withColumn("spans", greedy(F.col("spans"))), _K).select(_K, "start", "end", "type")


_ORG_TEXT = "CASE c_custkey % 4 WHEN 0 THEN 'the Reserve Bank of India' WHEN 1 THEN 'Reserve  Bank of INDIA' WHEN 2 THEN 'Reserve Bank of Indiana' ELSE c_name END"


@query(f"SELECT {_K}, {_ORG_TEXT} AS text FROM customer WHERE c_custkey % 4 >= 2")
def allowlist_antijoin(spark, sf_dir):
    one = F.expr(f"array(named_struct('start', 0, 'end', 5, 'type', 'ORG', 'text', {_ORG_TEXT}, 'score', 0.85D, 'source', 's'))").cast(SPANS)
    rows = read(spark, sf_dir, "customer").select(_K, admissible(one, Config()).alias("spans"))
    return span_rows(rows, _K).select(_K, "text")


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(lower(url), '^[a-z]+://([^/?#]*[.])?example[.]com([/?#:]|$)')")
def domain_allowlist_pages(spark, sf_dir):
    one = F.array(F.struct(F.lit(0).alias("start"), F.length("url").alias("end"), F.lit("URL").alias("type"), F.col("url").alias("text"), F.lit(0.6).alias("score"), F.lit("url").alias("source"))).cast(SPANS)
    rows = read(spark, sf_dir, "pages").select("page_id", admissible(one, Config(allow_domains=("example.com",))).alias("spans"))
    return rows.where(F.size("spans") > 0).select("page_id")


# --- pseudonyms ----------------------------------------------------------------------------------------------------------------


def _rand_sql(seed: str, at: int, below: int) -> str:
    part = f"substr({seed}, {8 * at + 1}, 8)" if at < 8 else f"substr(sha256({seed} || ':{at}'), 1, 8)"
    return f"(CAST('0x' || {part} AS BIGINT) % {below})"


def _letters_sql(seed: str, at: int, n: int) -> str:
    return " || ".join(f"chr(CAST(65 + {_rand_sql(seed, at + k, 26)} AS INT))" for k in range(n))


def _figures_sql(seed: str, at: int, n: int) -> str:
    return " || ".join(f"CAST({_rand_sql(seed, at + k, 10)} AS STRING)" for k in range(n))


_PAN = EMBEDDED["pan"][2]


@query(f"""WITH x AS (SELECT {_K}, {_PAN} AS v FROM customer), s AS (SELECT *, {_hmac_sql("'PAN|0|' || v")} AS h FROM x)
SELECT {_K}, {_letters_sql("h", 0, 3)} || substr(v, 4, 1) || {_letters_sql("h", 3, 1)} || {_figures_sql("h", 4, 4)} || {_letters_sql("h", 8, 1)} AS fake FROM s""")
def fake_pan(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(_K, fakes.fake_identifier("PAN", F.expr(_PAN), SALT).alias("fake"))


_GST = EMBEDDED["gstin"][2]


@query(f"SELECT {_K}, true AS shape, true AS same_pan FROM customer")
def fake_gstin_embeds_fake_pan(spark, sf_dir):
    v = F.expr(_GST)
    made = fakes.fake_identifier("GSTIN", v, SALT)
    return read(spark, sf_dir, "customer").select(_K, made.rlike(BY_NAME["gstin"].pattern.replace("\\b", "")).alias("shape"), (made.substr(3, 10) == fakes.fake_identifier("PAN", v.substr(3, 10), SALT)).alias("same_pan"))


_KEEP = {"aadhaar": "AADHAAR", "cin": "CIN", "din": "DIN", "sebi": "SEBI_REG", "ifsc": "IFSC", "passport": "PASSPORT", "ssn": "SSN", "bank_account": "BANK_ACCOUNT", "phone_intl": "PHONE", "phone_mobile": "PHONE"}


@query(" UNION ALL ".join(f"SELECT {_K}, '{n}' AS kind, true AS changed, true AS same_length, true AS same_shape FROM customer" for n in _KEEP))
def fake_identifier_invariants(spark, sf_dir):
    """Every pseudonym differs, keeps length and separators, and where a check figure exists it is right."""
    out = None
    for n, t in _KEEP.items():
        v = F.expr(EMBEDDED[n][2])
        made = fakes.fake_identifier(t, v, SALT)
        shape = lambda c: F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[A-Z]", "A")
        ok = shape(made) == shape(v)
        ok &= S.verhoeff_ok(made) if t == "AADHAAR" else F.lit(True)
        ok &= made.startswith("+91 ") if n == "phone_intl" else F.lit(True)
        rows = read(spark, sf_dir, "customer").select(_K, F.lit(n).alias("kind"), (made != v).alias("changed"), (F.length(made) == F.length(v)).alias("same_length"), ok.alias("same_shape"))
        out = rows if out is None else out.unionByName(rows)
    return out


_DOB = f"lpad(CAST(1 + {_K} % 28 AS STRING), 2, '0') || '/' || lpad(CAST(1 + {_K} % 12 AS STRING), 2, '0') || '/' || CAST(1930 + {_K} % 80 AS STRING)"


@query(f"""WITH x AS (SELECT {_K}, {_DOB} AS v FROM customer), s AS (SELECT *, {_hmac_sql("'DATE|' || v")} AS h FROM x),
d AS (SELECT {_K}, strptime(v, '%d/%m/%Y')::DATE + CAST(({_rand_sql("h", 0, 841)} + 60) * CASE WHEN {_rand_sql("h", 1, 2)} = 0 THEN 1 ELSE -1 END AS INT) AS moved FROM s)
SELECT {_K}, strftime(moved, '%d/%m/%Y') AS fake FROM d""")
def dob_shift(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(_K, fakes.fake_date(F.expr(_DOB), SALT).alias("fake"))


@query(f"""WITH x AS (SELECT {_K}, {EMBEDDED["ipv4"][2]} AS v FROM customer), s AS (SELECT *, {_hmac_sql("'IP|' || v")} AS h FROM x)
SELECT {_K}, ['192.0.2.', '198.51.100.', '203.0.113.'][{_rand_sql("h", 0, 3)} + 1] || CAST({_rand_sql("h", 1, 254)} + 1 AS STRING) AS fake FROM s""")
def fake_ip_ranges(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(_K, fakes.fake_ip(F.expr(EMBEDDED["ipv4"][2]), SALT).alias("fake"))


# --- dictionary ----------------------------------------------------------------------------------------------------------------

_GIVEN = ("Kiran", "Anita", "Rahul", "Priya", "Zubin")
_LAST = ("Mehta", "Rao", "Shah")
_PERSON = f"element_at(array{_GIVEN}, int(c_custkey % 5) + 1) || ' ' || element_at(array{_LAST}, int(c_custkey % 3) + 1)"


def _people(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").select((F.col(_K) % 40).alias("doc_id"), F.lit("PERSON").alias("type"), F.expr(_PERSON).alias("text"), (F.col(_K) * 100).cast("int").alias("start"), (F.col(_K) * 100 + 20).cast("int").alias("end"))


@query(f"""WITH p AS (SELECT c_custkey % 40 AS doc_id, {list(_GIVEN)}[c_custkey % 5 + 1] AS g, {list(_LAST)}[c_custkey % 3 + 1] AS s FROM customer)
SELECT DISTINCT doc_id, lower(g) AS token, 'given' AS role FROM p UNION SELECT DISTINCT doc_id, lower(s), 'surname' FROM p""")
def person_roles(spark, sf_dir):
    return dictionary.person_tokens(dictionary.values(_people(spark, sf_dir)))


@query(f"WITH p AS (SELECT c_custkey % 40 AS doc_id, {list(_LAST)}[c_custkey % 3 + 1] AS s FROM customer) SELECT doc_id, s AS surname, CAST(1 AS BIGINT) AS n_fakes FROM p GROUP BY ALL")
def family_surname_consistency(spark, sf_dir):
    last = lambda c: F.element_at(F.split(c, " "), -1)
    made = dictionary.build(_people(spark, sf_dir).withColumn("text", F.col("text")), SALT)
    return made.groupBy("doc_id", last(F.col("original")).alias("surname")).agg(F.countDistinct(last(F.col("pseudonym"))).alias("n_fakes"))


@query("SELECT n_nationkey, n_name AS original, CASE WHEN n_name = 'INDIA' THEN ['INDIA'] ELSE [n_name] END AS groups FROM nation")
def org_groups(spark, sf_dir):
    """Every nation's name before generic words; INDIA is generic itself, so the first word stands for it."""
    rows = read(spark, sf_dir, "nation")
    return rows.select("n_nationkey", F.col("n_name").alias("original"), dictionary.org_groups(F.concat(F.col("n_name"), F.lit(" Steel Industries Private Limited"))).alias("groups"))


def mails_follow_names(spark, sf_dir) -> DataFrame:
    """Whether the mailbox of each customer's name becomes that of the name's pseudonym in the customer's scope; every customer, every scope."""
    mail_of = lambda c, host: F.concat(F.lower(F.regexp_replace(c, " ", ".")), F.lit(host))
    rows = _people(spark, sf_dir)
    mail = rows.select("doc_id", F.lit("EMAIL").alias("type"), mail_of("text", "@gmail.com").alias("text"), "start", "end")
    made = dictionary.build(rows.unionByName(mail), SALT)
    person = made.where("type = 'PERSON'").select("doc_id", mail_of("original", "@gmail.com").alias("mail"), mail_of("pseudonym", "@example.com").alias("want"))
    pairs = made.where("type = 'EMAIL'").select("doc_id", F.col("original").alias("mail"), "pseudonym").join(person, ["doc_id", "mail"]).select("doc_id", "mail", (F.col("pseudonym") == F.col("want")).alias("follows"))
    back = read(spark, sf_dir, "customer").select(_K, (F.col(_K) % 40).alias("doc_id"), mail_of(F.expr(_PERSON), "@gmail.com").alias("mail"))
    return back.join(pairs, ["doc_id", "mail"]).select(_K, "follows")


@query(f"SELECT {_K}, true AS follows FROM customer")
def email_follows_name(spark, sf_dir):
    return mails_follow_names(spark, sf_dir)


_MAIL = EMBEDDED["email"][2]


@query(f"""WITH c AS (SELECT {_K} % 40 AS scope, {_PAN} AS pan, {_MAIL} AS mail FROM customer),
v AS (SELECT DISTINCT scope, 'PAN' AS type, pan AS v FROM c UNION SELECT DISTINCT scope, 'EMAIL', mail FROM c UNION SELECT DISTINCT scope, 'DOMAIN', split_part(mail, '@', 2) FROM c)
SELECT CAST(type AS STRING) AS type, count(*) AS n FROM v GROUP BY type""")
def mapping_counts(spark, sf_dir):
    """Distinct values of each type, a scope of forty at a time; hosts of mail are values too."""
    rows = read(spark, sf_dir, "customer").select((F.col(_K) % 40).alias("doc_id"), F.expr(f"'pan ' || ({_PAN}) || ' mail ' || ({EMBEDDED['email'][2]}) || ' end'").alias("text"))
    spans = span_rows(detect(rows), "doc_id")
    return dictionary.values(spans).groupBy("type").agg(F.count("*").alias("n"))


# --- tables --------------------------------------------------------------------------------------------------------------------


def _grid(spark, sf_dir) -> DataFrame:
    cells = "array(named_struct('r', 0, 'c', 0, 't', 'Name'), named_struct('r', 0, 'c', 1, 't', 'DIN'), named_struct('r', 0, 'c', 2, 't', 'Registered Address'), named_struct('r', 1, 'c', 0, 't', " + _PERSON + "), named_struct('r', 1, 'c', 1, 't', lpad(string(c_custkey), 8, '0')), named_struct('r', 1, 'c', 2, 't', 'Plot ' || string(c_custkey) || ', Mill Road, Pune 411 001'))"
    return read(spark, sf_dir, "customer").select(F.col(_K).alias("table_id"), F.explode(F.expr(cells)).alias("x")).select("table_id", F.col("x.r").alias("row_no"), F.col("x.c").alias("col_no"), F.col("x.t").alias("text"))


@query(f"""WITH p AS (SELECT c_custkey AS table_id, {list(_GIVEN)}[c_custkey % 5 + 1] || ' ' || {list(_LAST)}[c_custkey % 3 + 1] AS person, lpad(CAST(c_custkey AS STRING), 8, '0') AS din FROM customer)
SELECT table_id, 'PERSON' AS type, person AS text FROM p UNION ALL SELECT table_id, 'DIN', din FROM p UNION ALL SELECT table_id, 'ADDRESS', 'Plot ' || CAST(table_id AS STRING) || ', Mill Road, Pune 411 001' FROM p""")
def table_header_semantics(spark, sf_dir):
    return names.table_values(_grid(spark, sf_dir)).select("table_id", "type", "text")


# --- evaluation ----------------------------------------------------------------------------------------------------------------


def _eval(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer")
    cls = F.when(F.col(_K) % 3 == 0, "Names").when(F.col(_K) % 3 == 1, "Identifiers").otherwise("Contacts")
    truth = c.where("c_custkey % 10 < 8").select(F.col(_K).alias("id"), cls.alias("class"), F.concat(F.lit("value number "), F.col(_K).cast("string")).alias("value"), (F.col(_K) % 10 != 7).alias("detect"))
    found = c.where("c_custkey % 10 not in (0, 1)").select(F.col(_K).alias("id"), cls.alias("class"), F.concat(F.lit("value number "), F.col(_K).cast("string"), F.when(F.col(_K) % 10 == 9, "zz").otherwise("")).alias("value"))
    return found, truth


_METRICS = """
WITH c AS (SELECT c_custkey % 10 AS m, CASE c_custkey % 3 WHEN 0 THEN 'Names' WHEN 1 THEN 'Identifiers' ELSE 'Contacts' END AS class FROM customer),
k AS (SELECT class, sum(CASE WHEN m BETWEEN 2 AND 6 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN m IN (8, 9) THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN m IN (0, 1) THEN 1 ELSE 0 END)::BIGINT AS fn FROM c GROUP BY ROLLUP (class)),
r AS (SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(tp / (tp + fp + fn), 4) AS csi FROM k)
SELECT class, tp, fp, fn, precision, recall, round(2 * precision * recall / (precision + recall), 4) AS f1, csi FROM r"""


@query(_METRICS)
def metrics_strict(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    cls = F.when(F.col(_K) % 3 == 0, "Names").when(F.col(_K) % 3 == 1, "Identifiers").otherwise("Contacts")
    value = F.concat(F.lit("v"), F.sha2(F.col(_K).cast("string"), 256))
    truth = c.where("c_custkey % 10 < 8").select(F.col(_K).alias("id"), cls.alias("class"), value.alias("value"), (F.col(_K) % 10 != 7).alias("detect"))
    found = c.where("c_custkey % 10 not in (0, 1)").select(F.col(_K).alias("id"), cls.alias("class"), value.alias("value"))
    return audit.score(found, truth)


@query("SELECT class, count(*) AS measurable, CAST(sum(leaked) AS BIGINT) AS leaked FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Identifiers' ELSE 'Names' END AS class, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS leaked FROM customer) GROUP BY ROLLUP (class)")
def leak_test_by_class(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    kind = F.when(F.col(_K) % 2 == 0, "DIN").otherwise("PERSON")
    value = F.when(F.col(_K) % 2 == 0, F.lpad(F.col(_K).cast("string"), 8, "0")).otherwise(F.concat(F.lit("Person Q"), F.col(_K).cast("string"), F.lit(" Zed")))
    text = F.concat(F.lit("before "), value, F.lit(" after"))
    vals = c.select(F.col(_K).alias("doc_id"), kind.alias("type"), value.alias("original"))
    return audit.leaks(vals, c.select(F.col(_K).alias("doc_id"), text.alias("text")), c.select(F.col(_K).alias("doc_id"), F.when(F.col(_K) % 5 == 0, text).otherwise(F.lit("gone")).alias("text")))


@query("SELECT 'PERSON' AS type, replace(lower(n_name), '_', ' ') AS value, CAST(2 AS BIGINT) AS n FROM nation WHERE n_nationkey % 2 = 0")
def inconsistent_pseudonyms(spark, sf_dir):
    rows = read(spark, sf_dir, "nation")
    two = rows.select(F.lit("PERSON").alias("type"), F.col("n_name").alias("original"), F.lit("One").alias("pseudonym")).union(rows.select(F.lit("PERSON"), F.lower("n_name"), F.when(F.col("n_nationkey") % 2 == 0, "Two").otherwise("ONE")))
    return audit.inconsistent(two)


@query("SELECT n_name AS value FROM nation n WHERE NOT EXISTS (SELECT 1 FROM nation m WHERE m.n_nationkey % 3 = 0 AND contains('<' || m.n_name || '>', n.n_name))")
def trap_preservation(spark, sf_dir):
    rows = read(spark, sf_dir, "nation")
    return audit.lost(rows.select(F.col("n_name").alias("value")), rows.where("n_nationkey % 3 = 0").select(F.concat(F.lit("<"), "n_name", F.lit(">")).alias("text")))


@query(f"SELECT 'DIN' AS type, lpad(CAST({_K} AS STRING), 8, '0') AS value, 'din' AS rules, CAST(1 AS BIGINT) AS occurrences, {EMBEDDED['din'][1]} || {EMBEDDED['din'][2]} || {EMBEDDED['din'][3]} AS contexts FROM customer")
def annotate_propose(spark, sf_dir):
    kind, lead, value, tail = EMBEDDED["din"]
    rows = read(spark, sf_dir, "customer").select(F.col(_K).alias("doc_id"), F.expr(f"({lead}) || ({value}) || ({tail})").alias("text"))
    return audit.proposals(audit.in_context(detect(rows), "doc_id"))


@query("SELECT n_name AS value, CASE WHEN n_nationkey % 4 = 3 THEN 'ORG' ELSE 'PERSON' END AS type, n_nationkey % 4 = 2 AS negative FROM nation")
def annotate_ground_truth(spark, sf_dir):
    label = F.expr("element_at(array('TP', 'FN', 'FP', 'TYPE:ORG'), n_nationkey % 4 + 1)")
    return audit.ground_truth(read(spark, sf_dir, "nation").select(F.lit("PERSON").alias("type"), F.col("n_name").alias("value"), label.alias("label")))


# --- scanned images ------------------------------------------------------------------------------------------------------------


def _ocr(spark, sf_dir) -> DataFrame:
    """An image a customer: a label, a name in capitals below it, a blank word and an unsure one."""
    words = "array(named_struct('l', 0, 'x', 40, 't', 'Name', 'f', 90.0), named_struct('l', 0, 'x', 5, 't', 'Father', 'f', 90.0), named_struct('l', 1, 'x', 5, 't', 'QUINN', 'f', 80.0), named_struct('l', 1, 'x', 60, 't', 'ROWE', 'f', 80.0), named_struct('l', 1, 'x', 90, 't', ' ', 'f', 80.0), named_struct('l', 2, 'x', 5, 't', 'junk', 'f', -1.0), named_struct('l', 2, 'x', 9, 't', 'k' || string(c_custkey), 'f', 50.0))"
    w = read(spark, sf_dir, "customer").select(F.col(_K).cast("string").alias("image"), F.explode(F.expr(words)).alias("w"))
    return w.select("image", F.lit(0).alias("block"), F.lit(0).alias("par"), F.col("w.l").alias("line"), F.col("w.t").alias("text"), F.col("w.x").alias("left"), (F.col("w.l") * 20).alias("top"), F.lit(30).alias("width"), F.lit(10).alias("height"), F.col("w.f").cast("double").alias("conf"))


@query(f"SELECT CAST({_K} AS STRING) AS image, l AS line_no, CASE l WHEN 0 THEN 'Father Name' WHEN 1 THEN 'QUINN ROWE' ELSE 'k' || CAST({_K} AS STRING) END AS text FROM customer, (SELECT unnest([0, 1, 2]) AS l)")
def ocr_lines_from_words(spark, sf_dir):
    return ocr.lines(_ocr(spark, sf_dir)).select("image", "line_no", "text")


@query(f"SELECT CAST({_K} AS STRING) AS image, 1 AS line_no, 0 AS start, 10 AS \"end\", 'PERSON' AS type, 'QUINN ROWE' AS text, 'id_label_nextline' AS source FROM customer")
def id_label_nextline(spark, sf_dir):
    found = ocr.id_hits(ocr.lines(_ocr(spark, sf_dir)))
    return ocr.dedupe_hits(found)


@query(f"SELECT CAST({_K} AS STRING) AS image, 5 AS x0, 20 AS y0, 90 AS x1, 30 AS y1 FROM customer")
def ocr_hit_boxes(spark, sf_dir):
    rows = ocr.lines(_ocr(spark, sf_dir))
    return ocr.hit_boxes(rows, ocr.dedupe_hits(ocr.id_hits(rows))).select("image", "x0", "y0", "x1", "y1")


@query(f"SELECT CAST({_K} AS STRING) AS image, 'b' AS box_id, CAST(0.3 AS DOUBLE) AS cover FROM customer")
def text_cover(spark, sf_dir):
    w = _ocr(spark, sf_dir)
    boxes = w.select("image", F.lit("b").alias("box_id"), F.lit(0).alias("x0"), F.lit(20).alias("y0"), F.lit(100).alias("x1"), F.lit(40).alias("y1")).distinct()
    return ocr.text_cover(boxes, w)


@query(f"SELECT CAST({_K} AS STRING) AS image, CASE WHEN {_K} % 4 = 0 THEN 'skip' WHEN {_K} % 4 = 1 THEN 'paint' WHEN {_K} % 4 = 2 THEN 'obscure' ELSE 'leave' END AS action FROM customer")
def image_actions(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col(_K).alias("k"), F.col(_K).cast("string").alias("image"))
    images = c.select("image", F.when(F.col("k") % 4 == 0, 100).otherwise(500).alias("width"), F.lit(400).alias("height"), (F.col("k") % 4 == 2).alias("is_id"))
    return ocr.image_action(images, c.where("k % 4 = 1").select("image"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by class and type over the documents' identifiers."""
    return entity_counts_rollup(spark, sf_dir)


from . import coverage  # noqa: E402, F401 - registers its queries here
