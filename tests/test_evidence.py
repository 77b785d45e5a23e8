import hashlib

from loomgraph.plans import retrieval


def test_evidence_holds_whole_texts(spark):
    long = "word " * 200 + "end"
    docs = spark.createDataFrame([(1, "A", long), (2, None, None), (3, "C", "short"), (4, "D", "not listed")], "doc_id long, title string, text string")
    best = spark.createDataFrame([(7, 1, 2), (7, 3, 1), (7, 2, 3), (8, 1, 1)], "query_id long, doc_id long, rank int")
    got = {x.query_id: (x.evidence_md5, x.documents) for x in retrieval.evidence(best, docs).collect()}
    one = f"Q: What is A? A: {long}"
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == {7: (md5("Q: What is C? A: short\n" + one + "\nQ: What is ? A: "), 3), 8: (md5(one), 1)}


def test_baseline_evidence_reads_whole_texts(spark, sf):
    docs = {x.doc_id: x for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "title", "text").collect()}
    best = {}
    for x in retrieval.bm25_documents(spark, sf).where("rank <= 5").collect():
        best.setdefault(x.query_id, []).append((x.rank, x.doc_id))
    text = lambda d: f"Q: What is {docs[d].title or ''}? A: {docs[d].text or ''}"
    want = {q: hashlib.md5("\n".join(text(d) for _, d in sorted(ds)).encode()).hexdigest() for q, ds in best.items()}
    assert {x.query_id: x.evidence_md5 for x in retrieval.baseline_evidence(spark, sf).collect()} == want
    assert any(len(docs[d].text or "") > 300 for ds in best.values() for _, d in ds)
