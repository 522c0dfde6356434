"""Vector codes, exact top-k and the prefix trie against plain Python, on hard inputs and with every bound made small."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from verdant.llm import code_compression, prefix_trie, voronoi_topk
from verdant.llm.integers import small_type

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, label int, `row` string, q long, g int, `a.b` string"


def vector_rows(rng, n, dim, spread=0.2):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = [[i, [c + spread * rng.gauss(0, 1) for c in rng.choice(centres)], rng.choice([1, 2, None])] for i in range(n)]
    for i in range(5, n, 7):  # copies
        rows[i][1] = list(rows[i - 5][1])
    hard = [[n, None, 1], [n + 1, [NAN] * dim, 2], [n + 2, [INF] + [0.0] * (dim - 1), 2], [n + 3, [None] + [0.5] * (dim - 1), None], [n + 4, [], 1], [n + 5, [1.0] * (dim - 1), 1],
            [n + 6, [1e200] * dim, 1], [n + 7, [0.0] * dim, None], [3, list(rows[3 % n][1]), 2], [None, list(rows[4 % n][1]), 1]]
    return [(*r, "r", 1, 2, "x") for r in rows + hard]


def whole(v, dim):
    if v is None or len(v) != dim or any(x is None or not math.isfinite(x) or abs(x) > 1e6 for x in v):
        return None
    return [math.floor(256 * x) for x in v]


def brute_codes(rows, dim, parts, entries, rounds):
    held = sorted(((r[0], whole(r[1], dim), r[2]) for r in rows if whole(r[1], dim)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = dim // parts
    cut = [[tuple(q[p * w:p * w + w]) for p in range(parts)] for _, q, _ in held]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    for k in range(rounds + 1):
        found = [[min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p])) for p, x in enumerate(c)] for c in cut]
        if k < rounds:
            for p in range(parts):
                mine = defaultdict(list)
                for c, f in zip(cut, found, strict=True):
                    mine[f[p][1]].append(c[p])
                for j, xs in mine.items():
                    books[p][j] = [sum(x[i] for x in xs) // len(xs) for i in range(w)]
    told = [(i, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for (i, _, _), f in zip(held, found, strict=True)]
    return told, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest(), [r[2] for r in held]


@pytest.mark.parametrize(("n", "entries", "rounds"), [(400, 64, 4), (400, 8, 2), (20, 64, 2), (1, 64, 2), (300, 256, 1)])
def test_codes(spark, n, entries, rounds):
    rows = vector_rows(random.Random(n + entries), n, 16)
    codes = code_compression.compress(spark.createDataFrame(rows, VECTORS), parts=4, entries=entries, rounds=rounds, keep=["vec_id", "label", "row", "a.b"])
    want, sha, _ = brute_codes(rows, 16, 4, entries, rounds)
    assert sorted((str(r.row.vec_id), r.code, r.error) for r in codes.rows.collect()) == sorted((str(i), c, e) for i, c, e in want)
    assert codes.books_sha256() == sha


def test_codes_of_large_numbers(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1, 1]) * 1e6 * rng.random() for _ in range(4)], None, "r", 1, 2, "x") for i in range(60)]
    codes = code_compression.compress(spark.createDataFrame(rows, VECTORS), parts=2, entries=8, rounds=3)
    want, sha, _ = brute_codes([(r[0], [x if abs(x) <= 1e6 else 0 for x in r[1]], None) for r in rows], 4, 2, 8, 3)
    assert sorted((r.row.vec_id, r.code, r.error) for r in codes.rows.collect()) == sorted(want) and codes.books_sha256() == sha


def test_bounds_settle_most_parts():
    rng = np.random.default_rng(3)
    book = rng.integers(-200, 200, (64, 4))
    x = rng.integers(-200, 200, (3000, 4))
    state, _ = code_compression.assign_all(x, book, 16)
    moved_book = book + rng.integers(-4, 5, book.shape)
    moved = np.sqrt(((moved_book - book) ** 2).sum(1).astype(float)) * (1 + 1e-9)
    new, best = code_compression.assign_bounded(x, moved_book, state, moved, 8)
    far = code_compression.measure(x, moved_book)
    assert (best == far.min(1)).all() and (new["own"] == far.argmin(1)).all()
    assert (new["used"] == 0).mean() > 0.2 and (new["used"] <= 16).mean() > 0.9  # most rows never meet the whole codebook
    again, best = code_compression.assign_bounded(x, moved_book, new, np.zeros(64), 8)
    assert (best == far.min(1)).all() and (again["own"] == new["own"]).all()


@pytest.mark.parametrize("few", [10_000, 0])
def test_label_errors(spark, few, monkeypatch):
    monkeypatch.setattr(code_compression, "FEW_LABELS", few)
    rows = vector_rows(random.Random(5), 120, 16)
    want, _, labels = brute_codes(rows, 16, 4, 64, 2)
    total = defaultdict(int)
    for (_, _, e), label in zip(want, labels, strict=True):
        total[label] += e
    codes = code_compression.compress(spark.createDataFrame(rows, VECTORS), parts=4, keep=["vec_id", "label"])
    told = code_compression.with_group_errors(codes.rows.select("row.vec_id", "row.label", "code", "error"), "label").collect()
    assert len(told) == len(want) and all(r.label_error == total[r.label] for r in told)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1, "r", 1, 1, "x"), (2, [], None, None, None, None, None)]):
        table = spark.createDataFrame(rows, VECTORS)
        assert code_compression.compress(table, keep=["vec_id", "label"]).rows.count() == 0
        assert voronoi_topk.top_k(table, table.vec_id % 5 == 0).count() == 0


def brute_top(rows, every, k):
    held = [(r[0], [math.floor(256 * x) for x in r[1]]) for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) and abs(x) < 1e6 for x in r[1])]
    out = []
    for i, q in held:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in held if j != i and len(x) == len(q))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.02, 2.0])
def test_top_k(spark, spread, monkeypatch):
    rows = vector_rows(random.Random(4), 500, 8, spread)
    table = spark.createDataFrame(rows, VECTORS).repartition(5)

    def got(k):
        return sorted(tuple(r) for r in voronoi_topk.top_k(table, table.vec_id % 3 == 0, k=k).collect())

    assert got(5) == brute_top(rows, 3, 5)
    for name, value in (("QUERY_BLOCK", 7), ("DATA_BLOCK", 20), ("DATA_PER_QUERY", 1), ("_QUERIES", 4), ("_DATA", 16), ("REPLICAS", 50.0)):
        monkeypatch.setattr(voronoi_topk, name, value)
    assert got(3) == brute_top(rows, 3, 3)
    assert got(1000) == brute_top(rows, 3, 1000)  # fewer candidates than asked for


def test_top_k_of_large_numbers(spark):
    rng = random.Random(2)
    rows = [(i, [9e5 * rng.uniform(-1, 1) for _ in range(6)], 1, "r", 1, 1, "x") for i in range(80)]  # products beyond 2^53
    table = spark.createDataFrame(rows, VECTORS)
    assert sorted(tuple(r) for r in voronoi_topk.top_k(table, table.vec_id % 4 == 0).collect()) == brute_top(rows, 4, 5)
    assert [small_type(x).itemsize for x in (100, 128, 40_000, 1 << 40)] == [1, 2, 4, 8]


def test_bounds_prune_clusters():
    rng = np.random.default_rng(1)
    points = rng.normal(0, 100, (20, 9))
    counts = np.zeros((20, 50), np.int64)
    counts[:, 0] = 100  # tight cells
    ranges = {h: (np.maximum(g - 1, 0), g + 1) for h, g in enumerate(voronoi_topk._gaps(points, points))}
    of, low, high, copies = voronoi_topk.plan(points, counts, 1.0, ranges, 5, 4 * counts.sum())
    assert len(set(of.values())) == 20 and (copies <= 200).all()  # each group needs little beyond its own cell


CONVERSATIONS = "conv_id long, turn int, role string, text string, depth long, p1 string, g int"


def conversation_rows(rng, n):
    rows = []
    for c in range(n):
        conv = c * 3 if c % 4 else c // 4 * 100
        for t in range(rng.choice([0, 1, 2, 2, 3, 5, 9])):
            rows.append((conv, t, rng.choice(["user", None]), rng.choice(["a", "b", "", None, "Äß\U0001f600"])))
    rows += [(7, None, "user", "null turn"), (7, 0, "user", "x"), (9, 1, "u", "tie"), (9, 1, "u", "tie"), (9, 1, "u", "eit"), (None, 1, "user", "nobody"), (2000, 1, None, None)]
    rows += [(5000, t, "u", "same") for t in range(40)] + [(5001, t, "u", f"t{t % 3}") for t in range(60)] + [(6000 + i, t, "u", "copy") for i in range(30) for t in range(4)]
    rng.shuffle(rows)
    return [(*r, 1, "p", 2) for r in rows]


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        t = own.get(c - c % 100, [])[:h] + own[c][h:]
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for s in members:
        if s:
            children[s[:-1]] += 1
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in children
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1]) if s else 0
    return sorted((m[0], len(s), str(members[s[:-1]][0]) if s else "None", len(m), children.get(s, 0), leaves[s], saved[s], hashlib.sha256(",".join(map(str, ends.get(s, []))).encode()).hexdigest()) for s, m in members.items())


def told_trie(table):
    return sorted((r.conv_id, r.depth, str(r.parent_conv_id), r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.trie(table).collect())


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, small, monkeypatch):
    if small:
        for name, value in (("MEMBERS", 3), ("BAND", 4), ("HEAP", 2), ("CHUNK", 6)):
            monkeypatch.setattr(prefix_trie, name, value)
    rows = conversation_rows(random.Random(6), 90)
    assert told_trie(spark.createDataFrame(rows, CONVERSATIONS).repartition(6)) == brute_trie(rows)


def test_trie_without_rows(spark):
    assert told_trie(spark.createDataFrame([], CONVERSATIONS)) == []
    assert told_trie(spark.createDataFrame([(None, 1, "u", "t", 1, "p", 2)], CONVERSATIONS)) == []


def test_queue_spills_into_runs():
    rng = random.Random(1)
    queue, want = prefix_trie.MessageQueue(most=3), defaultdict(lambda: [0, 0])
    for _ in range(200):
        key, x = (rng.randrange(-3, 0), rng.randrange(5), 0), (rng.randrange(9), rng.randrange(9))
        queue.push(key, *x)
        want[key][0] += x[0]
        want[key][1] += x[1]
    assert queue.runs and [queue.take(k) for k in sorted(want)] == [tuple(want[k]) for k in sorted(want)]
    assert not queue.runs and not queue.heap
