"""Registered queries of the training-data operators and their DuckDB SQL.

Each query runs its operator with production parameters over the whole table
and derives the digest columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.llm import code_compression, decontaminate, hyperminhash, language_id, licenses, mixing, pivot_dedup, prefix_trie, quality, substring, suffix_family, toxicity, voronoi_topk
from verdant.llm.sampling import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op6_benchmark_decontamination", r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, ws[i:i + 9] AS p
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
place AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM phrase) WHERE len(ws) >= n),
hit AS (SELECT doc_id, item_id, i, phrase.n FROM place JOIN phrase ON place.n = phrase.n AND ws[i:i + place.n - 1] = p),
word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY 1),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT w.doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id", "n_words", decontaminate.n_in_spans().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


@query("op4_minhash_near_dedup", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM pair JOIN n nu ON u = nu.doc_id JOIN n nv ON v = nv.doc_id WHERE 100 * i >= 80 * (nu.n + nv.n - i)),
both_ways AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT both_ways.v, reach.c FROM reach JOIN both_ways ON both_ways.u = reach.id)
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, id = c AS kept
FROM (SELECT id, min(c) AS c FROM reach GROUP BY 1) LEFT JOIN n ON n.doc_id = id
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=80)


@query("op5_substring_dedup", r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
place AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
twice AS (SELECT p FROM place GROUP BY p HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 35)) AS k FROM place JOIN twice USING (p))),
word AS (SELECT doc_id, k, ws[k] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM w)),
left_over AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS kept FROM word ANTI JOIN hit USING (doc_id, k) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over USING (doc_id)
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated_spans(read(spark, sf_dir, "documents"), width=35).select(
        "row.doc_id", F.col("size").alias("n_words"), decontaminate.n_in_spans().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_suffix_array_dedup", r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, k, substr(h, 2 * k + 1, 798) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 200)) AS k FROM b)),
place AS (SELECT doc_id, k + j AS i, md5(substr(h, 2 * j - 1, 400)) AS p FROM (SELECT doc_id, k, h, unnest(range(1, least(201, length(h) // 2 - 198))) AS j FROM part)),
hit AS (SELECT doc_id, i FROM place SEMI JOIN (SELECT p FROM place GROUP BY p HAVING count(*) > 1) USING (p)),
island AS (SELECT doc_id, i, sum(CASE WHEN i - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hit)),
span AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM island GROUP BY doc_id, k),
gap AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS before FROM span),
cut AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(h, 2 * before - 1, 2 * (lo - before)), '' ORDER BY lo) AS head
  FROM gap JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 1) - 1))) AS kept_sha256
FROM b LEFT JOIN cut USING (doc_id)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_family.remove_repeated_bytes(read(spark, sf_dir, "documents"), width=200).select(
        "row.doc_id", F.col("size").alias("n_bytes"), decontaminate.n_in_spans().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs, remainder("doc_id", 4) != 2)
    return language_id.identify(docs, model, ["doc_id"]).select("row.doc_id", language_id.held_out("row.doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return toxicity.grade(docs, model, ["doc_id"]).select("row.doc_id", language_id.held_out("row.doc_id", 5, 0).alias("held_out"), "p_toxic", "severity", "grade", "toxic")


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return quality.score(docs, model, ["doc_id"]).select("row.doc_id", language_id.held_out("row.doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op1_license_scan", licenses.oracle_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).withColumns({c: F.concat_ws(",", c) for c in ("licenses", "unmatched")})


@query("op3_source_mixing", r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, '-') AS id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS t FROM documents),
s AS (SELECT source, sum(t)::BIGINT AS held FROM d GROUP BY source HAVING sum(t) > 0),
p AS (SELECT list(held / total) AS p, any_value(total) AS total, 0.95 * ln(count(*)) AS want FROM s, (SELECT sum(held)::DOUBLE AS total FROM s)),
flat(k, lo, hi) AS (
  SELECT 0, CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= want THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE FROM p
  UNION ALL
  SELECT k + 1, CASE WHEN ln(z) - m * l / z >= want THEN m ELSE lo END, CASE WHEN ln(z) - m * l / z >= want THEN hi ELSE m END
  FROM (SELECT k, lo, hi, m, want, list_sum(list_transform(p, lambda x: pow(x, m))) AS z, list_sum(list_transform(p, lambda x: pow(x, m) * ln(x))) AS l
        FROM (SELECT k, lo, hi, (lo + hi) / 2 AS m FROM flat WHERE k < 48), p)),
rare(k, lo, hi) AS (
  SELECT 0, lo, CASE WHEN list_max(list_transform(p, lambda x: pow(x, lo - 1))) / list_sum(list_transform(p, lambda x: pow(x, lo))) <= 4 THEN lo ELSE 1.0::DOUBLE END FROM flat, p WHERE k = 48
  UNION ALL
  SELECT k + 1, CASE WHEN r <= 4 THEN lo ELSE m END, CASE WHEN r <= 4 THEN m ELSE hi END
  FROM (SELECT k, lo, hi, m, list_max(list_transform(p, lambda x: pow(x, m - 1))) / list_sum(list_transform(p, lambda x: pow(x, m))) AS r
        FROM (SELECT k, lo, hi, (lo + hi) / 2 AS m FROM rare WHERE k < 48), p)),
a AS (SELECT hi AS a, list_sum(list_transform(p, lambda x: pow(x, hi))) AS z, total FROM rare, p WHERE k = 48),
q AS (SELECT source, held, floor(pow(held / total, a) / z * total)::BIGINT AS quota, ceil(held / 1000000.0)::BIGINT AS blocks FROM s, a),
placed AS (
  SELECT doc_id, d.source, id, t, coalesce(quota, 0) AS quota, quota // held AS passes, quota % held AS rest, ('0x' || substr(md5(id), 1, 8))::BIGINT % blocks AS block
  FROM d LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source),
b AS (SELECT source, block, sum(t)::BIGINT AS size, any_value(rest) AS rest, any_value(passes) AS passes FROM placed WHERE block IS NOT NULL GROUP BY 1, 2),
visit AS (
  SELECT source, block, size, least(size, greatest(0, rest - coalesce(sum(size) OVER (
    PARTITION BY source ORDER BY md5(concat_ws('|', coalesce(source, ''), block, passes)), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM b),
told AS (
  SELECT placed.*, size, take, coalesce(sum(t) OVER (PARTITION BY placed.source, placed.block ORDER BY md5(id), id, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM placed LEFT JOIN visit ON placed.source IS NOT DISTINCT FROM visit.source AND placed.block = visit.block)
SELECT doc_id, source, t AS n_tokens, block, quota, (coalesce(passes, 0) + CASE WHEN take > 0 AND (take = size OR before < take) THEN 1 ELSE 0 END)::BIGINT AS copies FROM told
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", "_mix.n_tokens", "_mix.block", "_mix.quota", "_mix.copies")


@query("op2_embedding_near_dedup", """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT link.v, reach.c FROM reach JOIN link ON link.u = reach.id),
n AS (SELECT u, count(*) AS n FROM link GROUP BY 1)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, id = c AS kept
FROM (SELECT id, min(c) AS c FROM reach GROUP BY 1) LEFT JOIN n ON n.u = id
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.95)


_WHOLE = """SELECT {columns}, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _compression_sql() -> str:
    """Explicit distances of every part to every entry, three times."""
    assign = """{a} AS (
  SELECT vec_id, p, v, arg_min(j, (d, j)) AS j, min(d) AS d
  FROM (SELECT s.vec_id, s.p, s.v, b.j, list_sum(list_transform(list_zip(s.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM part s JOIN {b} b USING (p))
  GROUP BY vec_id, p, v)"""
    update = """{b} AS (
  SELECT p, j, coalesce(n.v, o.v) AS v FROM {o} o LEFT JOIN (
    SELECT p, j, list((s - ((s % c) + c) % c) // c ORDER BY k) AS v
    FROM (SELECT p, j, k, sum(x)::BIGINT AS s, count(*) AS c FROM (SELECT p, j, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM {a}) GROUP BY p, j, k)
    GROUP BY p, j) n USING (p, j))"""
    return ("WITH e AS (" + _WHOLE.format(columns="vec_id, label") + """),
part AS (SELECT vec_id, p, q[p * (len(q) // 16) + 1:(p + 1) * (len(q) // 16)] AS v FROM e, range(16) r(p)),
b0 AS (SELECT p, j, v FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM e) USING (vec_id) WHERE j < 64),
""" + ",\n".join([assign.format(a="a0", b="b0"), update.format(b="b1", o="b0", a="a0"), assign.format(a="a1", b="b1"), update.format(b="b2", o="b1", a="a1"), assign.format(a="a2", b="b2")]) + """,
code AS (SELECT vec_id, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, j, k)) AS books FROM (SELECT p, j, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM b2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, books AS codebooks_sha256 FROM code JOIN e USING (vec_id), h""")


@query("op11_vector_code_compression", _compression_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = code_compression.compress(read(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256, keep=["vec_id", "label"])
    told = code_compression.with_group_errors(codes.rows.select("row.vec_id", "row.label", "code", "error"), "label")
    return told.select("vec_id", "code", "error", "label_error", F.lit(codes.books_sha256()).alias("codebooks_sha256"))


@query("op12_conversation_prefix_trie", """
WITH own AS (
  SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
head AS (
  SELECT conv_id, t, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::BIGINT, 1))::BIGINT)),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 6 AS h FROM own),
conv AS (SELECT head.conv_id, list_concat(coalesce(base.t, [])[1:h], head.t[h + 1:]) AS t FROM head LEFT JOIN own base ON base.conv_id = head.base),
place AS (SELECT conv_id, d, t[1:d] AS s, len(t) = d AS ends FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM conv)),
node AS (SELECT s, d, min(conv_id) AS conv_id, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids FROM place GROUP BY s, d),
child AS (SELECT s[1:d - 1] AS s, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
own_sum AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(s[d][2]) END AS saved FROM node LEFT JOIN child USING (s)),
total AS (SELECT s[1:k] AS s, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM own_sum) GROUP BY 1)
SELECT x.conv_id, x.d::BIGINT AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children, n_leaves, saved_tokens, sha256(coalesce(x.ids, '')) AS ends_sha256
FROM own_sum x JOIN total USING (s) LEFT JOIN node up ON x.d > 0 AND up.s = x.s[1:x.d - 1]
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


@query("op13_exact_topk_search", "WITH e AS (" + _WHOLE.format(columns="vec_id") + """),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)
