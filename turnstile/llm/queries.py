"""Registered queries of the training-data operators, whole tables each.

``op1`` .. ``op13`` apply one operator with its production parameters;
``pipeline`` runs ``corpus_pipeline.run``.
"""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm import (ann, bpe, conversations, embed_dedup, exact_dedup, hard_negatives, langid, licenses,
                           minhash, packing, quality, secrets, sharding)
from turnstile.llm.common import held_out, learnable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op2_bpe_forced_boundaries")
def op2_bpe_forced_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    out = bpe.encode_documents(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces with their sequence and place."""
    return packing.pack_documents(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op8_minhash_near_dedup")
def op8_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(table(spark, d, "documents"))


@register("op6_cross_parsing_language")
def op6_cross_parsing_language(spark: SparkSession, d: str) -> DataFrame:
    """Predicted language of all documents, learned from the other folds."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    parser = langid.train(docs.where(learnable(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), parser)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@register("op3_quality_boosted_trees")
def op3_quality_boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    """Quality score of all documents, learned from the other folds' labels."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels").where(learnable(F.col("doc_id")))
    scored = quality.score_documents(docs, quality.train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@register("op9_secret_markov_scan")
def op9_secret_markov_scan(spark: SparkSession, d: str) -> DataFrame:
    """Secrets of all documents: counts and digest of the rules' spans, and
    all spans."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = listed(F.filter("spans", lambda s: s["kind"] != "markov"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Language, quality, near-duplicates, secrets and packing in a row."""
    return corpus_pipeline.run(spark, d)


@register("op5_spherical_cap_dedup")
def op5_spherical_cap_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Links and components of all embeddings of one label."""
    return embed_dedup.near_vectors(table(spark, d, "embeddings"))


_NEAREST = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.e, c.e) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5"""


@register("op7_vantage_point_search", _NEAREST)
def op7_vantage_point_search(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest neighbours of every fiftieth embedding among all."""
    vectors = table(spark, d, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


@register("op1_lookup_table_sharding", sharding.oracle_sql("documents", "doc_id"))
def op1_lookup_table_sharding(spark: SparkSession, d: str) -> DataFrame:
    """Slot and shard of every document."""
    names = [f"shard-{k}" for k in range(sharding.SHARDS)]
    return sharding.place(table(spark, d, "documents").select("doc_id"), "doc_id", names)


@register("op4_license_paragraphs")
def op4_license_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Licence paragraphs of all documents."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.train(docs))


_COPIES = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER g = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)"""


@register("op12_two_pass_bloom_dedup", _COPIES)
def op12_two_pass_bloom_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Groups of equal texts of all documents and the row of each that stays."""
    return exact_dedup.find_copies(table(spark, d, "documents"))


_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                  CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
                  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
           FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same
                AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5"""


@register("op13_threshold_join_negatives", _NEGATIVES)
def op13_threshold_join_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Positives and hard negatives of every hundredth embedding among all."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


# The checksum bit by bit, the four states as a fold over rows and insertions, least (cost, audit) first.
_REPAIR = r"""
WITH keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
drawn AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) % 20 AS draw FROM keyed),
rows AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN draw = 3 THEN [1, 2] ELSE [1] END) AS copy FROM drawn WHERE draw <> 0),
placed AS (
  SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(role) || md5(text)), copy) AS n FROM rows),
told AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 3
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 1 ELSE 0 END AS f,
         coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i NOT IN ('su', 'ua', 'au'), false) AS bad FROM placed),
steps AS (
  SELECT conv_id, n, 1 AS part, f, i, role, text FROM told
  UNION ALL SELECT conv_id, n, 0, 9, '', '', '' FROM told, range(3)
  UNION ALL SELECT conv_id, max(n) + 1, 0, 9, '', '', '' FROM told, range(3) GROUP BY conv_id, range),
none AS (SELECT {'c': CAST(1000000000000 AS BIGINT), 'a': '', 'o': ''} AS s),
lists AS (
  SELECT conv_id, list({'f': f, 'i': i, 'r': role, 't': text, 'z': none.s, 's': none.s, 'u': none.s, 'v': none.s} ORDER BY n, part) AS l
  FROM steps, none GROUP BY conv_id),
ends AS (
  SELECT conv_id, list_reduce(list_prepend(
    {'f': 0, 'i': '', 'r': '', 't': '', 'z': {'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}, 's': none.s, 'u': none.s, 'v': none.s}, l),
    lambda p, x: CASE WHEN x.f = 9 THEN
      {'f': 0, 'i': '', 'r': '', 't': '', 'z': p.z, 's': p.s,
       'u': list_min([p.u, {'c': p.z.c + 5, 'a': p.z.a || 'I', 'o': p.z.o || chr(10) || 'user:'},
                      {'c': p.s.c + 5, 'a': p.s.a || 'I', 'o': p.s.o || chr(10) || 'user:'},
                      {'c': p.v.c + 5, 'a': p.v.a || 'I', 'o': p.v.o || chr(10) || 'user:'}]),
       'v': list_min([p.v, {'c': p.u.c + 5, 'a': p.u.a || 'I', 'o': p.u.o || chr(10) || 'assistant:'}])}
    ELSE
      {'f': 0, 'i': '', 'r': '', 't': '', 'z': {'c': p.z.c + 2, 'a': p.z.a || 'D', 'o': p.z.o},
       's': list_min([{'c': p.s.c + 2, 'a': p.s.a || 'D', 'o': p.s.o},
         {'c': p.z.c + CASE WHEN x.f > 1 OR x.i <> 's' THEN 1000000000000 ELSE 5 * x.f END, 'a': p.z.a || 'K', 'o': p.z.o || chr(10) || x.r || ':' || x.t}]),
       'u': list_min(list_concat([{'c': p.u.c + 2, 'a': p.u.a || 'D', 'o': p.u.o}], list_concat(
         list_transform([p.z, p.s, p.v], lambda y: {'c': y.c + CASE WHEN x.f > 1 THEN 1000000000000 ELSE 1 + 5 * x.f END, 'a': y.a || 'R', 'o': y.o || chr(10) || 'user:' || x.t}),
         list_transform([p.z, p.s, p.v], lambda y: {'c': y.c + CASE WHEN x.f > 1 OR x.i <> 'u' THEN 1000000000000 ELSE 5 * x.f END, 'a': y.a || 'K', 'o': y.o || chr(10) || x.r || ':' || x.t})))),
       'v': list_min([{'c': p.v.c + 2, 'a': p.v.a || 'D', 'o': p.v.o},
         {'c': p.u.c + CASE WHEN x.f > 1 THEN 1000000000000 ELSE 1 + 5 * x.f END, 'a': p.u.a || 'R', 'o': p.u.o || chr(10) || 'assistant:' || x.t},
         {'c': p.u.c + CASE WHEN x.f > 1 OR x.i <> 'a' THEN 1000000000000 ELSE 5 * x.f END, 'a': p.u.a || 'K', 'o': p.u.o || chr(10) || x.r || ':' || x.t}])} END) AS e
  FROM lists, none),
best AS (SELECT conv_id, list_min([e.z, e.v]) AS b FROM ends),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 3) AS blank,
         count(*) FILTER (WHERE f = 2) AS duplicate, count(*) FILTER (WHERE f = 1) AS truncated, count(*) FILTER (WHERE bad) AS illegal
  FROM told GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit,
       sha256(coalesce(substr(b.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON o.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id"""


@register("op11_hirschberg_repair", _REPAIR)
def op11_hirschberg_repair(spark: SparkSession, d: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of all damaged conversations."""
    given = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair_report(conversations.damaged(given), given)
