"""Every operator on nulls, empty and very long texts, ties, repeated rows,
empty tables and clashing column names, against plain Python where it applies."""

import random

import pytest

from tests.llm import brute
from verdant.llm import decontaminate, hyperminhash, language_id, licenses, mixing, pivot_dedup, quality, substring, suffix_family, toxicity
from verdant.llm.sampling import remainder

OPERATORS = {
    1: lambda d: licenses.scan(d),
    3: lambda d: mixing.mix(d),
    4: lambda d: hyperminhash.near_duplicates(d),
    5: lambda d: substring.remove_repeated_spans(d, keep=d.columns),
    6: lambda d: decontaminate.contamination(d, d.sparkSession.createDataFrame([(1, "w1 w2"), (None, None), (3, ""), (None, "zz")], "item_id long, text string"), keep=d.columns),
    7: lambda d: suffix_family.remove_repeated_bytes(d, keep=d.columns),
    8: lambda d: language_id.identify(d, language_id.fit(d, remainder("doc_id", 4) != 2), d.columns),
    9: lambda d: toxicity.grade(d, toxicity.fit(d, labels(d), None), d.columns),
    10: lambda d: quality.score(d, quality.fit(d, labels(d), remainder("doc_id", 5) != 0), d.columns),
}


def labels(d):
    rows = [(1, 1, 0), (3, 0, 1), (4, 1, 1), (4, 0, 0), (None, 1, 1), (8, None, None), (99, 1, 0)]
    return d.sparkSession.createDataFrame(rows if d.limit(1).count() else [], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("n", sorted(OPERATORS))
def test_one_row_for_each_row(n, hard_docs, no_docs):
    assert OPERATORS[n](hard_docs).count() == hard_docs.count()
    assert OPERATORS[n](no_docs).count() == 0


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(k, hard_docs):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(hard_docs, shingle=k).collect())
    rows = pairs(hard_docs)
    want = brute.near_duplicates([x for x in rows if x[0] is not None], k)
    sizes = [brute.near_duplicates([(0, t)], k)[0][0] for _, t in rows]
    assert got == sorted((str(d), n, want[d][1] if d is not None else None, want[d][2] if d is not None else True) for (d, _), n in zip(rows, sizes, strict=True))


def test_repeated_words(hard_docs):
    rows = pairs(hard_docs)
    split = [brute.words(t) for _, t in rows]
    gone = brute.repeats(split, 35)
    want = sorted((str(d), len(w), len(x), brute.runs(x), " ".join(y for i, y in enumerate(w) if i not in x).encode()) for (d, _), w, x in zip(rows, split, gone, strict=True))
    got = sorted((str(r.row.doc_id), r["size"], sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in substring.remove_repeated_spans(hard_docs).collect())
    assert got == want
    for r in substring.remove_repeated_spans(hard_docs, keep=["doc_id", "text"], as_is=True).collect():
        assert r.spans or bytes(r.kept) == (r.row.text or "").encode()


def test_repeated_bytes(hard_docs):
    rows = pairs(hard_docs)
    data = [(t or "").encode() for _, t in rows]
    gone = brute.repeats(data, 200)
    want = sorted((str(d), len(b), len(x), brute.runs(x), bytes(c for i, c in enumerate(b) if i not in x)) for (d, _), b, x in zip(rows, data, gone, strict=True))
    got = sorted((str(r.row.doc_id), r["size"], sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffix_family.remove_repeated_bytes(hard_docs).collect())
    assert got == want


def test_benchmark_words(spark, hard_docs, monkeypatch):
    rows = pairs(hard_docs)
    text = dict(rows)[1].split()
    items = [(1, " ".join(text[5:30]).upper()), (2, "X"), (3, None), (4, ""), (10, " ".join(text[20:29])), (None, "1234--5678"), (7, "w1 w2 w3 never")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(d), n, len(hit), brute.runs(hit), ",".join(found)) for (d, _), (n, hit, found) in zip(rows, brute.contamination(rows, [("null" if i is None else i, t) for i, t in items]), strict=True))

    def got():
        return sorted((str(r.row.doc_id), r.n_words, sum(s.stop - s.start for s in r.spans), len(r.spans), ",".join(r["items"])) for r in decontaminate.contamination(hard_docs, table).collect())

    assert got() == want
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 50)  # many shards
    assert got() == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)  # several blocks of phrases
    assert got() == want


def test_cut_words(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two, THREE four! and (that)"), (2, None), (3, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one TWO three FOUR")], "item_id long, text string")
    told = decontaminate.contamination(docs, items, keep=["doc_id", "text"])
    assert {r.doc_id: r.t for r in told.select("row.doc_id", decontaminate.cut("row.text", "spans").alias("t")).collect()} == {1: "Keep this. ! and (that)", 2: None, 3: "none"}


def test_vectors(spark):
    rng = random.Random(3)
    a = [rng.gauss(0, 1) for _ in range(8)]
    near = [x + 0.01 * rng.gauss(0, 1) for x in a]
    nan, inf = float("nan"), float("inf")
    rows = [(5, a, 1), (2, near, None), (9, [2 * x for x in a], 1), (9, a, 2), (3, [-x for x in a], 1), (4, None, 1), (6, [0.0] * 8, 1), (7, [nan] + a[1:], 1), (8, [inf] + a[1:], 1), (10, [None, *a[1:]], 1), (None, a, 1), (11, [], 1), (12, a[:4], 1), (13, a[:4], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in pivot_dedup.near_duplicates(table).collect()}
    alone = {(i, 0, i, True) for i in (3, 4, 6, 7, 8, 10, 11)}
    assert alone <= got and (None, 0, None, True) in got
    assert {(12, 1, 12, True), (13, 1, 12, False), (2, 3, 2, True), (5, 3, 2, False)} <= got
    assert pivot_dedup.near_duplicates(table.limit(0)).count() == 0


def test_languages_and_scores_of_empty_texts(hard_docs):
    told = {r.row.doc_id: (r.lang_pred, r.score) for r in OPERATORS[8](hard_docs).collect() if r.row.doc_id in (5, 6, 7, 13, 1)}
    assert all(told[d] == ("und", 0.0) for d in (5, 6, 7, 13)) and told[1][0] in ("en", "fr") and 0 <= told[1][1] <= 1
    assert all(0 <= r.score <= 1 for r in OPERATORS[10](hard_docs).collect())
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.severity <= 3 for r in OPERATORS[9](hard_docs).collect())


def test_license_sequences(spark):
    texts = [
        (1, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
        (2, "Released under the MIT License. One. Two. Three. Four. Five. ALL RIGHTS RESERVED!"),
        (3, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
        (4, "not licensed"), (5, None), (6, "Licensed under CC BY-NC 4.0"),
    ]
    got = {r.doc_id: (r.n_sentences, r.licenses, r.unmatched, r.sequence) for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1] == (3, ["BSD-2-Clause"], [], "[BSDpre][BSDsource][BSDbinary]")
    assert got[2] == (2, ["LicenseRef-AllRightsReserved", "MIT"], [], "[MITname]~[AllRights]")
    assert got[3] == (1, [], ["BSDsource"], "[BSDsource]")
    assert got[4] == got[5] == (0, [], [], "") and got[6][1] == ["CC-BY-NC-4.0"]


def test_mixture(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["t"] * rng.randrange(0, 40)), s) for i, s in enumerate(["a"] * 300 + ["b"] * 60 + [None] * 30 + ["empty"] * 3)]
    rows = [(i, "" if s == "empty" else t, s) for i, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    held = {}
    for _, t, s in rows:
        held[s] = held.get(s, 0) + len(t.split())
    total = sum(held.values())
    some = [s for s in held if held[s]]
    for entropy, most in ((0.95, 4.0), (1.0, 1.8), (0.1, 4.0)):
        a = brute.exponent([held[s] / total for s in some], entropy, most)
        z = sum((held[s] / total) ** a for s in some)
        told = mixing.mix(docs, entropy=entropy, repeats=most, block_tokens=200).collect()
        assert len(told) == len(rows)
        for s in held:
            mine = [r for r in told if r.source == s]
            quota = {r._mix.quota for r in mine}
            want = (held[s] / total) ** a / z * total if held[s] else 0
            assert len(quota) == 1 and abs(quota.pop() - want) <= 1
            assert want - 1 <= sum(r._mix.copies * r._mix.n_tokens for r in mine) <= want + 40 * (want > 0)
            assert {r._mix.copies for r in mine} <= {int(want // max(held[s], 1)), int(want // max(held[s], 1)) + 1} if held[s] else {r._mix.copies for r in mine} == {0}
        passes = mixing.realise(mixing.mix(docs, entropy=entropy, repeats=most, block_tokens=200))
        assert passes.count() == sum(r._mix.copies for r in told)
