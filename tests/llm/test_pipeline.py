"""The pipeline against its stages applied by hand, in plain Python where that is short."""

import corpus_pipeline
from wardline.llm import common, mixing, neardup, packing, pii, tokencount

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    start = {r.doc_id: r for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        if name != "packing":
            assert docs.columns == columns
        seen.append((name, before, docs))
    by = {n: (a, b) for n, a, b in seen}
    assert {r.doc_id for r in by["language"][1].collect()} == {i for i, r in start.items() if any(c.isalpha() for c in r.text)}
    gone = {r.doc_id for r in neardup.duplicates(by["near_duplicates"][0]).collect()}
    assert gone and {r.doc_id for r in by["near_duplicates"][1].collect()} == {r.doc_id for r in by["near_duplicates"][0].collect()} - gone
    for r in by["personal_data"][1].collect():
        was = start[r.doc_id].text
        assert r.text == pii.redact(was, pii.find(was)) and r.n_chars == len(r.text)
    copies = {r.doc_id: r.copies for r in mixing.rates(by["mixing"][0]).collect()}
    counts = {r.doc_id: r["count"] for r in by["mixing"][1].groupBy("doc_id").count().collect()}
    assert counts == copies
    out = by["packing"][1].collect()
    encode = tokencount.counter().encoding.encode_ordinary
    want = sum(len(encode(r.text)) for r in by["mixing"][1].collect())
    assert sum(r.n_tokens for r in out) == want and all(r.capacity in packing.LENGTHS for r in out)


def test_odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, an empty table, and columns with clashing names."""
    long = "The lake and the hill were white with snow, and the road was long. " * 5_000
    words = [f"The {a} of the {b} and the {c} were seen in the morning." for a in ("lake", "hill", "road") for b in ("north", "south") for c in ("snow", "sand", "wind")]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(words)] + [(30, None, None, None, None), (31, "", "en", "s0", 0), (None, words[0] + " No id.", "en", None, 9), (33, long, None, "s1", len(long)), (34, words[2], "en", None, 9), (34, words[2], "en", None, 9)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _gone int, gone int, n_tokens int, row int")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        if name != "packing":
            assert after.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = after
        ids = {r.doc_id for r in docs.collect()}
        assert None in ids and 33 in ids and not ids & {30, 31}
    assert 34 not in ids  # a copy of an earlier one


def test_run_leaves_its_result_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, SF)
    assert len(list(tmp_path.iterdir())) == 1 and out.count() > 0
