"""The last pass over a source: its blocks and rows against plain Python, broadcast or shuffled."""
import hashlib
import random

import pytest

from verdant.llm import mixing


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def visited(rows):
    """Row numbers of one source that the last, partial pass visits."""
    held = sum(r._mix.n_tokens for r in rows)
    left = rows[0]._mix.quota % held if held else 0
    blocks = {}
    for r in rows:
        blocks.setdefault(r._mix.block, []).append(r)
    out = set()
    for block in sorted(blocks, key=lambda b: md5(f"{rows[0].source or ''}|{b}|{rows[0]._mix.passes}")):
        size = sum(r._mix.n_tokens for r in blocks[block])
        for r in sorted(blocks[block], key=lambda r: (md5(str(r.doc_id)), str(r.doc_id))):
            if left > 0 and size > 0 and (size <= left or r.before(blocks[block]) < left):
                out.add(r.doc_id)
        left -= min(size, left)
    return out


class Row:
    def __init__(self, r):
        self.doc_id, self.source, self._mix = r.doc_id, r.source, r._mix

    def before(self, block):
        mine = (md5(str(self.doc_id)), str(self.doc_id))
        return sum(r._mix.n_tokens for r in block if (md5(str(r.doc_id)), str(r.doc_id)) < mine)


@pytest.mark.parametrize("most", [100_000, 0])
def test_last_pass_against_plain_python(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", most)
    rnd = random.Random(5)
    docs = [(i, " ".join("w" * rnd.randint(0, 12)), rnd.choice(["a", "a", "a", "b", None])) for i in range(400)]
    docs += [(1000 + i, "", "a") for i in range(40)] + [(2000 + i, None, "no words") for i in range(3)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for budget in (None, 700, 5000):
        by_source = {}
        for r in mixing.mix(table, entropy=0.9, budget=budget, block_tokens=20).collect():
            by_source.setdefault(r.source, []).append(Row(r))
        assert len(by_source) == 4 and max(r._mix.block or 0 for r in by_source["a"]) > 40
        for rows in by_source.values():
            want = visited(rows)
            assert {r.doc_id for r in rows if r._mix.part} == want
            assert all(r._mix.copies == (r._mix.passes or 0) + (r.doc_id in want) for r in rows)


def test_clashing_names(spark):
    import corpus_pipeline
    docs = spark.createDataFrame([(1, "one two", "a", 7, "x", 1.0, 3), (2, None, None, 8, "y", 2.0, 4)], "doc_id long, text string, source string, n_tokens int, pass string, position double, end int")
    got = corpus_pipeline.mix_sources(spark, docs, "")
    assert sorted(got.columns) == ["doc_id", "end", "n_tokens", "pass", "position", "source", "text"]
    assert [(r.doc_id, r.n_tokens, r["pass"], r.end) for r in got.collect()] == [(1, 2, 0, 3)]
