"""The registered document queries also find people, organisations and addresses."""

from collections import Counter

from mosaicveil.operators.names import find_addresses, find_orgs, find_people
from mosaicveil.plans.queries import QUERIES

TEXTS = [
    "Report by Mr. Rahul Mehta of the board.",
    "We thank Acme Steel Private Limited for it.",
    "Office: Plot 4, Mill Road, Shivaji Nagar, Pune 411 001, India",
    "nothing of the kind in here",
]


def _tables(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _brute():
    """These texts have no identifiers and no overlaps: what the finders yield stays as it is."""
    return {(k, s[0], s[1], s[2], s[3]) for k, t in enumerate(TEXTS) for find in (find_people, find_orgs, find_addresses) for s in find(t)}


def test_detected_and_counted(spark, tmp_path):
    want, sf = _brute(), _tables(spark, tmp_path)
    assert {w[3] for w in want} == {"PERSON", "ORG", "ADDRESS"}
    assert {(r.doc_id, r.start, r.end, r.type, r.text) for r in QUERIES["detect_documents"](spark, sf).collect()} == want
    counted = {r["type"]: r["n"] for r in QUERIES["entity_counts_rollup"](spark, sf).collect() if r["type"]}
    assert counted == Counter(w[3] for w in want)


def test_redacted(spark, tmp_path):
    want, sf = _brute(), _tables(spark, tmp_path)
    done = {r.doc_id: r for r in QUERIES["redact_documents"](spark, sf).collect()}
    assert all(w[4] not in done[w[0]].text for w in want)
    assert all(done[w[0]].n_replaced > 0 for w in want)
    assert done[3].text == TEXTS[3] and done[3].n_replaced == 0
