"""Recall of the index, held-out accuracy of the classifiers, and the routing of crowded groups."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import SF
from verdant.llm import groups, hyperminhash, language_id, queries, repeats, shared, substring, suffix_family
from verdant.llm.text import mix


def test_pivot_index_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in queries.QUERIES["op2_embedding_near_dedup"](spark, SF).collect()}
    assert sum(got.values()) >= 0.9 * links.sum() and all(got[r.vec_id] <= n for r, n in zip(rows, links, strict=True))


def test_languages_held_out(spark, sample_docs):
    truth = {r.doc_id: r.lang for r in sample_docs.select("doc_id", "lang").collect()}
    told = [r for r in queries.QUERIES["op8_language_id"](spark, SF).collect() if r.held_out and truth[r.doc_id]]
    assert len(told) > 100 and np.mean([truth[r.doc_id] == r.lang_pred for r in told]) > 0.97


def test_quality_held_out(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    told = [r for r in queries.QUERIES["op10_quality_classifier"](spark, SF).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([truth[r.doc_id] == r.predicted for r in told]) > 0.95


def test_toxicity_held_out(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    told = [r for r in queries.QUERIES["op9_toxicity"](spark, SF).collect() if r.doc_id in truth]
    clean = [r for r in told if not truth[r.doc_id]]
    assert not [r for r in clean if r.toxic] and any(r.toxic for r in told if r.held_out)
    assert all((r.grade > 0) == r.toxic and 0 <= r.severity <= 3 for r in told)


def test_crowded_anchors_and_clusters(spark, hard_docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in hard_docs.select("doc_id", "text").collect()]
    monkeypatch.setattr(repeats, "CROWD", 1)
    for f, split, width in ((substring.remove_repeated_spans, brute.words, 35), (suffix_family.remove_repeated_bytes, lambda t: (t or "").encode(), 200)):
        want = sorted(map(len, brute.repeats([split(t) for _, t in rows], width)))
        assert sorted(sum(s.stop - s.start for s in r.spans) for r in f(hard_docs).collect()) == want
    monkeypatch.setattr(hyperminhash, "BUCKET_BLOCK", 2)
    monkeypatch.setattr(hyperminhash, "CLUSTER_BLOCK", 2)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(100) if j != 3 * i)) for i in range(12)], "doc_id long, text string")
    want = brute.near_duplicates([(r.doc_id, r.text) for r in docs.collect()], 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(docs, shingle=4).collect()}
    assert got == want


def test_groups_are_whole(spark):
    import pyarrow as pa
    batches = [pa.RecordBatch.from_pydict({"g": x}) for x in ([1, 1], [1], [1, 2, 2], [], [3], [3, 3, 4], [5])]
    seen = [batch.column(0).to_pylist()[a:b] for batch, bounds in groups.whole_groups(iter(batches)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert seen == [[1, 1, 1, 1], [2, 2], [3, 3, 3], [4], [5]]


def test_estimates_follow_jaccard():
    rng = np.random.default_rng(1)
    for n in (30, 500, 20_000):
        base = mix(rng.integers(0, 2**63, n, dtype=np.uint64))
        alike = np.concatenate([base[: int(n * 0.9)], mix(rng.integers(0, 2**63, n - int(n * 0.9), dtype=np.uint64))])
        unlike = mix(rng.integers(0, 2**63, n, dtype=np.uint64))
        a, b, c = (hyperminhash.registers(np.sort(x), np.array([0, len(x)])) for x in (base, alike, unlike))
        count = np.array([n])
        assert hyperminhash.may_be_similar(a, b, count, count, 80)[0]
        assert not hyperminhash.may_be_similar(a, c, count, count, 80)[0]


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(700, 600 + i) for i in range(30)]
    want = brute.components({x for p in links for x in p}, links)
    want = {x: c for x, c in want.items() if any(x in p and p[0] != p[1] for p in links)}
    df = spark.createDataFrame(links, "u long, v long").repartition(5)
    for few in (shared.FEW_EDGES, 0):  # by one task, by rounds
        monkeypatch.setattr(shared, "FEW_EDGES", few)
        rows = shared.components(df).collect()
        assert len(rows) == len(want) and {r.u: r.c for r in rows} == want
    assert shared.components(df.limit(0)).count() == 0


def test_pairs_of_languages_vote():
    pairs = [(0, 1), (0, 2), (1, 2)]
    margin = np.array([[1, 0.2, -3.0], [1, -0.5, 0.3], [-1, 2, 0.5], [0.1, -0.4, 0.2], [0, 0, 0]])
    won, least = language_id.vote(margin, pairs, 3)
    assert won.tolist() == [0, 0, 1, 2, 0] and np.allclose(least, [0.2, -0.5, 0.5, -0.2, 0])


def test_three_languages_of_a_family(spark):
    rng = np.random.default_rng(7)
    own = {"da": ["af", "ikke", "blev", "hvad"], "nb": ["av", "ikke", "ble", "hva"], "sv": ["av", "inte", "blev", "vad"], "fi": ["talo", "ja", "mutta", "hyvin"]}
    common = ["og", "der", "den", "for", "som", "men", "man", "land"]
    rows = [(4 * i + k, " ".join(rng.choice(words + (common if lang != "fi" else []), 30)), lang) for i in range(60) for k, (lang, words) in enumerate(own.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.col("doc_id") < 160)
    assert [len(p) for p in model.pairs] == [0 if len(f) == 1 else 3 for f in model.families] and sorted(map(len, model.families)) == [1, 3]
    assert model.weights.shape[1] == 2 + 3
    told = {r.doc_id: (r.lang_pred, r.learned) for r in language_id.identify(docs, model, ["doc_id"]).select("row.doc_id", "lang_pred", "learned").collect()}
    held = [(told[d], lang) for d, _, lang in rows if d >= 160]
    assert np.mean([p == lang and learned for (p, learned), lang in held]) > 0.95
