"""Catalogue of the operators' queries; ORACLES holds DuckDB equivalents where SQL can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.llm import (
    chat, mixing, near_dedup, packing, passages, personal_data, prefix_counts, quality, repair, repeats, suffix_tree, topk, whitening,
)
from barframe.session import ship_package

QUERIES = {}
ORACLES: dict[str, str] = {}
VOCAB = "byte_bpe_50k.json"


def query(fn):
    """Register ``fn(spark, sf_dir)`` under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCAB), capacity=1024, end_id=2)


@query
def op10_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = prefix_counts.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCAB))
    return prefixes.filter("block = 0").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query
def op3_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, seed=17)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op3_pareto_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap
  FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT source, source_size, least(cap, coalesce(w * (SELECT arg_min(level, cap / w) FROM l WHERE level * w <= cap), cap)) AS target
  FROM l),
q AS (
  SELECT d.*, source_size, target, (4 + floor(log2(size + 1)))::BIGINT AS q
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
lv AS (SELECT source, q, any_value(target) AS target, sum(size)::BIGINT AS words FROM q GROUP BY source, q),
c0 AS (
  SELECT source, q, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY source ORDER BY q DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / nullif(sum(words * q) OVER (PARTITION BY source ORDER BY q DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS c
  FROM lv),
c AS (SELECT source, arg_max(c, q) FILTER (c * q <= 2.0) AS c FROM c0 GROUP BY source),
e AS (
  SELECT q.*, least(2.0::DOUBLE, coalesce(c.c, 2.0::DOUBLE) * q) AS due FROM q JOIN c ON q.source IS NOT DISTINCT FROM c.source),
u AS (
  SELECT *, floor(due)::BIGINT AS whole, due - floor(due) AS p,
    (('0x' || substr(md5(doc_id::VARCHAR || ':17'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM e),
k AS (
  SELECT *, CASE WHEN p > 0 THEN floor((u / (1 - u) * ((1 - p) / p)) / (1 + u / (1 - u) * ((1 - p) / p)) * 1099511627776.0::DOUBLE)::BIGINT END AS rank
  FROM u),
o AS (SELECT source, any_value(target) - sum(whole * size)::DOUBLE AS open FROM k GROUP BY source),
g AS (SELECT source, rank, sum(size)::BIGINT AS words FROM k WHERE rank IS NOT NULL GROUP BY source, rank),
f AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY rank)::BIGINT AS upto FROM g),
b AS (
  SELECT f.source, arg_min(CASE WHEN upto - open < open - (upto - words) THEN rank ELSE rank - 1 END, rank) AS last_rank
  FROM f JOIN o ON f.source IS NOT DISTINCT FROM o.source WHERE upto >= open GROUP BY f.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN rank IS NOT NULL AND (b.source_found IS NULL OR rank <= b.last_rank) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k LEFT JOIN (SELECT *, true AS source_found FROM b) b ON k.source IS NOT DISTINCT FROM b.source
"""


@query
def op7_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(
        [(-7, k, role, r"\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))], turns.schema
    )
    return chat.digests(chat.render(chat.as_log(turns.unionByName(control))))


ORACLES["op7_chat_events"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, role AS r, coalesce(text, '') AS text, text AS t FROM conversations
  UNION ALL
  SELECT -7, k, ['user', 'assistant'][k + 1], ['user', 'assistant'][k + 1], '\### Assistant: </turn> ok', '' FROM range(2) x(k))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(regexp_replace(role, '([\\#<:' || chr(10) || '])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g'))
    + length('### : </turn>') + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@query
def op9_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), scale=256.0)
    return topk.top_inner_products(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


ORACLES["op9_maxscore_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op2_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), confidence=quality.CONFIDENCE)


@query
def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@query
def op4_longest_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.without_repeats(table(spark, sf_dir, "documents"), length=200)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"), folds=7, fold=2)


@query
def op8_boosted_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(repair.damaged(table(spark, sf_dir, "conversations")))


def _before(way: str, cost: str, letter: str) -> str:
    """SQL of a way (nine digits of cost, then its audit) with an edit before it; '~' is no way."""
    return f"CASE WHEN {way} = '~' THEN '~' ELSE lpad((substr({way}, 1, 9)::INTEGER + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({way}, 10) END"


ORACLES["op11_conversation_repair"] = rf"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS codes
  FROM conversations),
d AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d
  FROM k, t),
e AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) FROM d) WHERE d <> 0),
f AS (
  SELECT *, left(role, 1) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn
  FROM e),
g AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY rn) AS li
  FROM f),
h AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (li IS NOT NULL AND li || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM g GROUP BY conv_id),
w AS (
  SELECT conv_id, n AS rn, '000000000' AS s0, '000000010II' AS s1, '000000005I' AS s2, '000000000' AS s3 FROM h
  UNION ALL
  SELECT conv_id, rn - 1, least(s0, {_before("n2", "5", "I")}), least(s1, {_before("n2", "5", "I")}), n2, least(s3, {_before("s2", "5", "I")})
  FROM (SELECT *, least(s2, {_before("s3", "5", "I")}) AS n2 FROM (
    SELECT conv_id, rn,
      least({_before("s0", "2", "D")}, CASE WHEN stays THEN least({_before("s2", "more + 1", "R")},
        CASE i WHEN 's' THEN {_before("s1", "more", "K")} WHEN 'u' THEN {_before("s2", "more", "K")} ELSE '~' END) ELSE '~' END) AS s0,
      least({_before("s1", "2", "D")}, CASE WHEN stays THEN least({_before("s2", "more + 1", "R")},
        CASE i WHEN 'u' THEN {_before("s2", "more", "K")} ELSE '~' END) ELSE '~' END) AS s1,
      least({_before("s2", "2", "D")}, CASE WHEN stays THEN least({_before("s3", "more + 1", "R")},
        CASE i WHEN 'a' THEN {_before("s3", "more", "K")} ELSE '~' END) ELSE '~' END) AS s2,
      least({_before("s3", "2", "D")}, CASE WHEN stays THEN least({_before("s2", "more + 1", "R")},
        CASE i WHEN 'u' THEN {_before("s2", "more", "K")} ELSE '~' END) ELSE '~' END) AS s3
    FROM (
      SELECT w.conv_id, w.rn, w.s0, w.s1, w.s2, w.s3, g.i, g.fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN g.fault = 'truncated' THEN 5 ELSE 0 END AS more
      FROM w JOIN g ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND w.rn = g.rn)))),
a AS (SELECT conv_id, substr(s0, 1, 9)::BIGINT AS cost, substr(s0, 10) AS audit FROM w WHERE rn = 0),
-- At these costs an inserted turn never pays: its neighbour can go instead. So the k-th letter is the k-th row's.
l AS (
  SELECT g.*, substr(audit, g.rn::BIGINT, 1) AS letter FROM g JOIN a ON g.conv_id IS NOT DISTINCT FROM a.conv_id),
m AS (
  SELECT *, count(*) FILTER (letter <> 'K' OR i <> 's') OVER (PARTITION BY conv_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM l WHERE letter <> 'D'),
r AS (
  SELECT conv_id, string_agg((CASE WHEN letter = 'K' THEN role WHEN before % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY rn) AS whole
  FROM m GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN h ON c.conv_id IS NOT DISTINCT FROM h.conv_id
LEFT JOIN a ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""


@query
def op13_doubled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = passages.without_repeated_windows(table(spark, sf_dir, "documents"), length=13)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op13_doubled_windows"] = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS doc,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
p AS (SELECT r, doc_id, doc, unnest(range(1, len(ws) + 1)) AS k, ws FROM w),
g AS (SELECT r, doc, k, array_to_string(ws[k:k + 12], ' ') AS gram FROM p WHERE k + 12 <= len(ws)),
f AS (SELECT gram, min(doc) AS lo FROM g GROUP BY gram HAVING min(doc) < max(doc)),
s AS (SELECT DISTINCT r, unnest(range(k, k + 13)) AS k FROM g JOIN f USING (gram) WHERE lo < doc),
l AS (
  SELECT w.r, string_agg(ws[p.k], ' ' ORDER BY p.k) AS kept, count(*) AS n
  FROM w JOIN (SELECT r, k FROM p) p ON w.r = p.r LEFT JOIN s ON s.r = p.r AND s.k = p.k WHERE s.r IS NULL GROUP BY w.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN l ON l.r = w.r
"""


@query
def op12_contour_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=32)


ORACLES["op6_chosen_path"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS v, doc_id AS r FROM w UNION SELECT reach.v, e.b FROM reach JOIN e ON e.a = reach.r),
c AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.v = w.doc_id
"""
