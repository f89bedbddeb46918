"""The op queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinade.llm.common import crc_mod, delete_at_exit, scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinade.llm.toxicity import toxicity_scores

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity_scores(docs, labels, crc_mod("doc_id", 5) != 0)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinade.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


def op1_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinade.llm.pivot_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinade.llm.token_store import read_checks, write_store

    path = scratch(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    delete_at_exit(spark, path)
    return read_checks(spark, path)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinade.llm.near_duplicates import join_classes

    return join_classes(table(spark, sf_dir, "documents"), threshold=0.8)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinade.llm.quality import quality_scores

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_scores(docs, labels, crc_mod("doc_id", 3) != 1)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinade.llm.secrets import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinade.llm.language import identify

    found = identify(table(spark, sf_dir, "documents"), crc_mod("doc_id", 3) != 1)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinade.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=0, capacity=2048)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinade.llm.decontaminate import decontaminate, digest

    return digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op11_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinade.llm.sharding import assign, digest

    return digest(assign(table(spark, sf_dir, "documents"), shards=24))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinade.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from affinade.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_pivot_search": op1_pivot_search,
    "op2_token_store": op2_token_store,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_quality": op4_quality,
    "op5_secret_scan": op5_secret_scan,
    "op6_language": op6_language,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_stratified_shards": op11_stratified_shards,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}

OP10_SQL = """
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT k FROM win),
place AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, size WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, i, k FROM place JOIN win USING (k, p)),
word AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pair AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pair) WHERE rank <= 5
"""

# The CRC-32 of bytes: a table by its polynomial, and its step for each byte.
CRC_TABLE = """
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) AS v
    FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; needs ``crc_table`` among the tables of FROM."""
    pairs = f"regexp_extract_all(hex(encode({text})), '..')"
    numbers = f"list_transform({pairs}, lambda p: CAST('0x' || p AS BIGINT))"
    return f"xor(CAST(4294967295 AS BIGINT), list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {numbers}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"


OP11_SQL = f"""
WITH {CRC_TABLE},
doc AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum, strlen(coalesce(text, '')) + 8 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32
  FROM documents, crc_table),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('42:', doc_id)), doc_id, size, text_crc32) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM doc),
placed AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * r - 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), stratum) - 1 AS place, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, place * 24 // total AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

OP12_SQL = f"""
WITH {CRC_TABLE},
own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 32),
    sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
head AS (SELECT conv_id, s, {crc_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM own, crc_table),
seq AS (SELECT a.conv_id, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s FROM head a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
beginning AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS p FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seq)),
node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(p[d].t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) END AS own_saved
  FROM beginning GROUP BY 1, 2),
member AS (SELECT b.conv_id AS c, n.conv_id, d FROM beginning b JOIN node n USING (p, d)),
linked AS (SELECT DISTINCT a.conv_id, a.d, b.conv_id AS below, b.d AS below_d FROM member a JOIN member b ON a.c = b.c AND b.d >= a.d),
child AS (SELECT conv_id, d, count(*) AS n FROM linked WHERE below_d = d + 1 GROUP BY 1, 2),
parent AS (SELECT below AS conv_id, below_d AS d, conv_id AS parent_conv_id FROM linked WHERE below_d = d + 1),
total AS (
  SELECT l.conv_id, l.d, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum(own_saved) AS saved
  FROM linked l JOIN node b ON b.conv_id = l.below AND b.d = l.below_d LEFT JOIN child c ON c.conv_id = l.below AND c.d = l.below_d GROUP BY 1, 2)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(coalesce(child.n, 0) AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM node LEFT JOIN parent USING (conv_id, d) LEFT JOIN child USING (conv_id, d) JOIN total USING (conv_id, d)
"""

OP13_SQL = """
WITH row_words AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
first AS (SELECT text, min(doc_id) AS least_id FROM row_words GROUP BY 1),
mark AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
doc AS (
  SELECT id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > least_id, false)} AS f
  FROM row_words JOIN first USING (text) LEFT JOIN mark USING (doc_id)),
fail AS (
  SELECT id, part, good, toxic, letter FROM (
    SELECT id, part, good, toxic, unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([f.A, f.B, f.C, f.D, f.E]) AS failed FROM doc) WHERE failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
ord AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
step AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest(string_split(filter_order, '')) AS letter FROM ord),
gone AS (
  SELECT part, filter_order, step, count(*) AS removed, sum(good) AS good_lost, sum(toxic) AS toxic_lost
  FROM (SELECT id, part, filter_order, min(good) AS good, min(toxic) AS toxic, min(step) AS step FROM fail JOIN step USING (letter) GROUP BY id, part, filter_order)
  GROUP BY 1, 2, 3),
total AS (SELECT part, count(*) AS n FROM doc GROUP BY 1),
failing AS (SELECT part, letter, count(*) AS n, count(*) FILTER (WHERE single) AS alone FROM (SELECT part, letter, count(*) OVER (PARTITION BY id) = 1 AS single FROM fail) GROUP BY 1, 2),
full_rows AS (
  SELECT part, filter_order, step, letter, n, coalesce(removed, 0) AS removed, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost
  FROM total CROSS JOIN step LEFT JOIN gone USING (part, filter_order, step))
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(r.n - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step) AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(coalesce(f.n, 0) - removed AS BIGINT) AS redundant, CAST(coalesce(alone, 0) AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM full_rows r LEFT JOIN failing f USING (part, letter)
"""

ORACLE_SQL: dict[str, str] = {"op1_pivot_search": OP1_SQL, "op10_benchmark_decontamination": OP10_SQL, "op11_stratified_shards": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_filter_audit": OP13_SQL}
