"""The pipeline's stages, one after another, against plain Python."""

import random
import re

import corpus_pipeline
from tests.llm import brute
from verdant.llm.shared import stage

SMALL = "/root/testdata/sf0.001"
EXTRA = [(900001, None, None, "src1", None), (900002, "12 34 !!", "en", None, 8), (900003, "", "en", "src2", 0)]


def brute_stages(rows, benchmark):
    """Texts by id after each of the first four stages (all real documents are in a language)."""
    docs = {d: t for d, t in rows if t and re.search(r"[^\W\d_]", t)}
    yield dict(docs)
    kept = brute.near_duplicates(sorted(docs.items()), 5)
    docs = {d: t for d, t in docs.items() if kept[d][2]}
    yield dict(docs)
    ids = sorted(docs)
    split = [brute.words(docs[d]) for d in ids]
    gone = brute.repeats(split, 35)
    docs = {d: docs[d] if not x else " ".join(y for i, y in enumerate(w) if i not in x) for d, w, x in zip(ids, split, gone, strict=True) if not x or len(x) < len(w)}
    yield dict(docs)
    ids = sorted(docs)
    for d, (n, hit, _) in zip(ids, brute.contamination([(d, docs[d]) for d in ids], benchmark), strict=True):
        if hit and len(hit) == n:
            del docs[d]
        elif hit:
            place = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", docs[d])]
            drop = {i for k in hit for i in range(*place[k])} | {i for k in hit if k + 1 in hit for i in range(place[k][1], place[k + 1][0])}
            docs[d] = "".join(c for i, c in enumerate(docs[d]) if i not in drop)
    yield dict(docs)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(EXTRA, docs.schema)).unionByName(docs.where("doc_id = 7"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_stages(rows, [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()])
    names = docs.columns
    for (name, step), expected in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = stage(step(spark, docs, SMALL), re.sub(r"\W", "_", name))
        assert docs.columns == names
        got = {}
        for r in docs.collect():
            assert r.n_chars == len(r.text)
            got[r.doc_id] = r.text
        assert got == expected, name
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    tokens = sum(len(brute.words(t)) for t in expected.values())
    assert set(r.doc_id for r in mixed) <= set(expected) and all(r.text == expected[r.doc_id] for r in mixed)
    assert abs(sum(r.n_tokens for r in mixed) - tokens) <= sum(sorted(len(brute.words(t)) for t in expected.values())[-20:])
    assert len({(r.doc_id, r["pass"]) for r in mixed}) == len(mixed)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SMALL)
    assert docs.count() == 0


def test_texts_in_no_learned_language(spark):
    rng = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = ["".join(rng.choice("бвгджзклмнпрст" if i % 2 else "bcdfghjklmnpqrstvwxz") for _ in range(1200)) for i in range(20)]
    noise += ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300)) for _ in range(10)]
    extra = spark.createDataFrame([(10**6 + 4 * i + 2, t, None, "src1", len(t)) for i, t in enumerate(noise)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(extra), "").select("doc_id").collect()}
    assert not [i for i in kept if i >= 10**6]
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}
