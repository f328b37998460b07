"""The pipeline, stage by stage, against brute force on the smallest tables."""

import hashlib

import corpus_pipeline
from fidelis.llm import decontamination, line_dedup, quality_rules
from tests.llm.test_operators import brute_components, brute_lines


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    at = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, data).write.parquet(f"file://{tmp_path}/{name}")
        at = spark.read.parquet(f"file://{tmp_path}/{name}")
        seen[name] = at
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == names
    rows = lambda d: {r["doc_id"]: r for r in d.collect()}
    kept = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    one, two, three, four, five = (rows(seen[n]) for n, _ in corpus_pipeline.STAGES)
    assert set(one) == kept
    gone = brute_lines([(i, r["text"]) for i, r in one.items()])
    want = {i: "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone[i]) for i, r in one.items()}
    assert {i: r["text"] for i, r in two.items()} == want and all(r["n_chars"] == len(r["text"]) for i, r in two.items() if gone[i])
    root = brute_components(list(want.items()), 5, 80)
    assert set(three) == {i for i in want if root[i][1] == i}
    items = decontamination.compiled([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()])
    canon = decontamination.Canon()
    assert set(four) == {i for i in three if not decontamination.matched(want[i], items, canon)}
    assert set(five) == set(four) and all(r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() for r in five.values())
    whole = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, data).collect()}
    assert whole == {i: r["ids_sha256"] for i, r in five.items()}
    assert line_dedup.MIN_WORDS == 5


def _folder(spark, tmp_path, rows, extra=""):
    documents = "doc_id long, text string, lang string, source string, n_chars long" + extra
    spark.createDataFrame(rows, documents).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "What is the name of the small boat that crossed the bay at noon?")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}"


def _prose(seed, n=90):
    import random

    rng = random.Random(seed)
    words = "the a of and in to was were with from that mill boat river lantern bridge stone walked under over quiet morning harbour letters garden window".split()
    return " ".join(rng.choice(words) for _ in range(n)) + "."


def test_stages_on_special_rows(spark, tmp_path):
    """Nulls in any column, empty texts, a row twice, an id with two texts, no id, a very long text, a column with an inner name."""
    block = "\n".join(_prose(100 + k, 12) for k in range(6))
    texts = [(1, _prose(1)), (1, _prose(1)), (2, None), (3, ""), (4, _prose(4)), (4, _prose(44)), (None, _prose(5)), (None, None), (6, " ".join("the" if k % 4 == 0 else f"word{k}" for k in range(60_000))), (7, _prose(4).replace("river", "brook", 1)), (8, f"{_prose(8)}\n{block}"), (9, f"{block}\n{_prose(9)}"), (10, _prose(10) + " What is the name of the small boat that crossed the bay at noon?")]
    rows = [(i, t, None if k % 2 else "en", None, None if k % 3 else len(t or ""), "x", k) for k, (i, t) in enumerate(texts)]
    out = corpus_pipeline.run(spark, _folder(spark, tmp_path, rows, ", node string, key long"))
    got = sorted((r["doc_id"] or 0, r["key"]) for r in out.collect())
    # Without a text nothing passes the rules; a row twice is one document and stays as it was; 7 is near 4, 10 holds an item.
    assert got == [(0, 6), (1, 0), (1, 1), (4, 4), (4, 5), (6, 8), (8, 10), (9, 11)]
    assert all(r["node"] == "x" and r["n_tokens"] > 50 for r in out.collect())
    assert {r["doc_id"]: r["n_chars"] for r in out.collect()}[9] == len(_prose(9))  # its block went, and n_chars was counted anew


def test_stages_on_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, _folder(spark, tmp_path, []))
    assert out.count() == 0 and {"doc_id", "lang", "source", "n_chars", "n_tokens", "ids"} <= set(out.columns)
