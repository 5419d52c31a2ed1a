"""The pipeline's stages against brute force, each on what its predecessor kept."""

import corpus_pipeline as cp
from tests.llm import brute
from trailspark.llm import tokens, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] >= 0.7}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    kept, want = docs, {d: t for d, t in rows.items() if d not in toxic}
    kept = cp.drop_toxic(spark, kept, SF)
    assert kept.columns == list(cp.COLUMNS) and {r["doc_id"]: r["text"] for r in kept.collect()} == want
    kept = cp.drop_near_duplicates(spark, kept, SF)
    want = {d: want[d] for d, (_, c) in brute.op1(want.items()).items() if c == d}
    assert kept.columns == list(cp.COLUMNS) and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    kept = cp.drop_contaminated(spark, kept, SF)
    want = {d: want[d] for d, r in brute.op2(want.items(), bench).items() if not r[4]}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    kept = cp.mix_sources(spark, kept, SF)
    mixed = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == list(cp.COLUMNS) and {d for d, _ in mixed} <= set(want) and max(map(mixed.count, mixed)) <= 3
    from tokenizers import Tokenizer

    got = cp.write_tokens(spark, kept, SF).collect()
    encoder, start = Tokenizer.from_file(tokens.vocabulary_path()), 0
    count = {d: len(encoder.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start and r["n_tokens"] == count[r["doc_id"]]
        start += r["n_tokens"]
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in mixed)
    whole = cp.run(spark, SF).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, got))


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", "en", None, 1), (1, "a b c d e f", "en", None, 1), (1, "other words", "en", "s", 1), (None, "a b c d e f", None, "s", 1), (None, None, None, None, None), (2, "A B C D E F", "en", "s", 1), (3, "", "en", "s", 0), (4, "x " * 50_000, "en", "t", 0)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int")
    kept = cp.drop_near_duplicates(spark, docs, SF)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (0, "a b c d e f"), (1, "a b c d e f"), (3, ""), (4, "x " * 50_000)]
    assert cp.drop_contaminated(spark, docs, SF).count() == 8
    assert cp.drop_toxic(spark, docs, SF).count() == 8
    assert {r["doc_id"] for r in cp.mix_sources(spark, docs, SF).collect()} >= {3}
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0
