"""Queries that work on every row, whatever part of it their SQL lists."""

from mosaicveil.plans import queries


def test_mail_follows_name_in_every_scope(spark, tmp_path):
    spark.range(1, 401).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_custkey: r.follows for r in queries.mails_follow_names(spark, str(tmp_path)).collect()}
    assert got == {k: True for k in range(1, 401)}


def test_all_documents_are_redacted(spark, tmp_path, monkeypatch):
    from mosaicveil.plans import redact

    texts = ["plain words", "mail a.b@mail.example.org please", "", None, "By Mr. Rahul Mehta alone"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, whole = [], redact.redact_texts
    monkeypatch.setattr(redact, "redact_texts", lambda docs, *a, **k: seen.append(docs.count()) or whole(docs, *a, **k))
    rows = queries.redact_leaves_plain_documents(spark, str(tmp_path)).collect()
    assert seen == [5] and {(r.doc_id, r.n) for r in rows} == {(0, 11), (2, 0)}
