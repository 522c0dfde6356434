"""Quality scores against a plain vote, one document at a time."""

import pyarrow as pa

from verdant.llm import quality
from verdant.llm.sampling import remainder
from verdant.llm.text import slices

SF = "/root/testdata/sf0.001"


def plain_score(model, text):
    """The labels of the NEIGHBOURS greatest cosines, weighted by their fourth powers."""
    x = next(iter(slices(pa.array([text], pa.string()), max_rows=1)))
    x = quality.term_features(x)[0].astype(float)
    if not x.any():
        return model.prior, 0.0
    z = [sum((a - m) * w for a, m, w in zip(x, model.centre.astype(float), column, strict=True)) for column in model.project.T.astype(float)]
    length = sum(c * c for c in z) ** 0.5 or 1.0
    cosines = sorted(((sum(a * b for a, b in zip(z, v, strict=True)) / length, float(label)) for v, label in zip(model.vectors.astype(float).tolist(), model.labels, strict=True)), key=lambda p: -p[0])
    near, rest = cosines[:quality.NEIGHBOURS], cosines[quality.NEIGHBOURS:]
    gap = near[-1][0] - rest[0][0] if rest else 1.0
    weights = [max(c, 0.0) ** 4 for c, _ in near]
    if not sum(weights):
        return model.prior, gap
    return sum(w * label for w, (_, label) in zip(weights, near, strict=True)) / sum(weights), gap


def test_scores_equal_a_plain_vote(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, remainder("doc_id", 5) != 0)
    assert len(model.vectors) > quality.NEIGHBOURS
    judged = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    compared = 0
    for r in quality.score(judged, model, ["doc_id", "text"]).collect():
        expected, gap = plain_score(model, r.row.text)
        if r.row.text and gap < 1e-5:  # a tie at the last neighbour: either vote is right
            continue
        compared += 1
        assert abs(r.score - expected) < 1e-4, (r.row.doc_id, r.score, expected, gap)
    assert compared > 50
