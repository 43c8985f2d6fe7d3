"""The registered queries of the subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import (chat, decontam, langid, lattice_lm, linkgraph, mixing, mtree, packing, prefixtrie, quality, simhash,
                            spelling, token_counts)
from ledgerlens.llm.common import crc32_mod, table, written

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: Rules of the URL filter: host, path prefix, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every sentence of every document; one that crosses a border counts where its last character lies."""
    out = token_counts.section_counts(table(spark, sf_dir, "documents"), token_counts.sentence_spans, BYTE_RANKS, "end")
    return out.select(F.col("id").alias("doc_id"), "section", "start", "end", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing")


def quality_grade() -> Column:
    """The rating of a labels row: 0 poor, 1 good but toxic, 2 good and clean."""
    return F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), 2)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality_grade(), 3)
    out = quality.predict(docs, model)
    return out.select(F.col("id").alias("doc_id"), "expected_grade", F.col("tails")[0].alias("p_grade_1"),
                      F.col("tails")[1].alias("p_grade_2"), (F.col("tails")[1] >= 0.5).alias("keep"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lattice_lm.score_texts(table(spark, sf_dir, "documents"), crc32_mod(F.col("doc_id"), 7) != 2, PIECES)
    return out.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    one = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], talk.schema)
    template = chat.Template()
    return chat.digests(chat.format_turns(talk.union(one), BYTE_RANKS, template), BYTE_RANKS, template).drop("n_tokens")


OP4_SQL = r"""
WITH talk AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, regexp_replace(regexp_replace(text, '(<)(\\*(?:/s>|s>|\|endoftext\|>))', '\1\\\2', 'g'),
                           '(\[)(\\*/?INST\])', '\1\\\2', 'g') AS safe FROM talk)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + length(role) + 6 + 7 + 4) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linkgraph.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "trust", "distrust")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE, 2048, 0).withColumnRenamed("id", "doc_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.col("component").alias("component_id"))


def op8_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10, 1024)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair with at least 0.8 of the item's five-word shingles in the document."""
    out = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "matched", "n_shingles", "containment")


OP9_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[^\x00-\x20\x7f!-/:-@\[-`{-~]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(lower(text), '[^\x00-\x20\x7f!-/:-@\[-`{-~]+') FROM benchmark),
n AS (SELECT kind, id, w, CASE WHEN kind = 'b' THEN least(5, len(w)) ELSE 5 END AS k FROM words),
b AS (SELECT DISTINCT id AS item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
      FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM n WHERE kind = 'b' AND k > 0)),
d AS (SELECT DISTINCT id AS doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
      FROM (SELECT id, w, x.k AS k, unnest(range(1, len(w) - x.k + 2)) AS i
            FROM n, (SELECT DISTINCT k FROM b) x WHERE kind = 'd')),
size AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS matched FROM b JOIN d USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, matched, n_shingles, matched / n_shingles AS containment
FROM m JOIN size USING (item_id) WHERE matched >= ceil(0.8 * n_shingles - 1e-9)
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod(F.col("doc_id"), 3) == 1
    model = langid.fit(docs, ~held_out)
    out = langid.predict(docs, model)
    return out.select(F.col("id").alias("doc_id"), (crc32_mod(F.col("id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations, which share up to three first turns within blocks of 20 ids."""
    paths = written(prefixtrie.conversation_paths(table(spark, sf_dir, "conversations")))
    return prefixtrie.prefix_trie(prefixtrie.with_shared_start(paths, 20, 3))


#: crc32 of the text {0}, a byte at a time: eight steps of shift and xor behind each byte.
CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
  range(octet_length(encode({0}))), lambda i: [('0x' || hex(encode({0}))[2 * i + 1 : 2 * i + 2])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""

OP11_SQL = rf"""
WITH turns AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (SELECT *, {CRC32_SQL.format("conv_id::VARCHAR")} % 4 AS h FROM turns),
built AS (
  SELECT c.conv_id, list_concat(coalesce(d.own, [])[1 : c.h], c.own[c.h + 1 :]) AS path
  FROM cut c LEFT JOIN turns d ON d.conv_id = c.conv_id - c.conv_id % 20),
prefix AS (SELECT conv_id, unnest(range(len(path) + 1)) AS depth, path FROM built),
node AS (
  SELECT path[1 : depth] AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256
  FROM prefix GROUP BY ALL),
child AS (SELECT key[1 : depth - 1] AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children,
    (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(key[depth].t, '[^\x20\x09-\x0D]+')) END AS own_saved
  FROM node LEFT JOIN child USING (key)),
above AS (SELECT key[1 : d] AS key, own_saved, n_children FROM (SELECT *, unnest(range(depth + 1)) AS d FROM full_node)),
subtree AS (SELECT key, sum(own_saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM full_node n JOIN subtree USING (key) LEFT JOIN full_node p ON n.depth > 0 AND p.key = n.key[1 : n.depth - 1]
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH RECURSIVE doc AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
run AS (SELECT id, unnest(regexp_extract_all(text, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM doc),
each AS (SELECT id || ':' || w AS salted, w, count(*) AS n FROM run GROUP BY id, w),
hashed AS (SELECT w, n, {CRC32_SQL.format("salted")} AS h FROM each),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
voc AS (SELECT word, sum(n)::BIGINT AS n FROM cut GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
hole AS (SELECT word, unnest(range(length(word))) AS i FROM voc),
less AS (SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM hole),
pair AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN voc b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM less a JOIN voc b ON a.rest = b.word),
near AS (SELECT p.word, count(*) AS n_near, min(struct_pack(m := -v.n, o := p.other)) AS best FROM pair p JOIN voc v ON v.word = p.other GROUP BY p.word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.o END AS form,
    CASE WHEN -best.m >= 2 * n THEN (-best.m)::BIGINT END AS form_n
  FROM voc LEFT JOIN near USING (word)),
chain AS (
  SELECT word, coalesce(form, word) AS root, 1 AS step FROM formed
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
ended AS (SELECT word, max_by(root, step) AS root FROM chain GROUP BY word)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN ended USING (word)
"""


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, sources, mix = mixing.mix(table(spark, sf_dir, "documents"))
    taken = mix.groupBy("row").agg(F.sum("words").alias("taken"))
    named = sized.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
    return named.join(taken, "row", "left").select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                                                   F.coalesce("taken", F.lit(0)).alias("taken"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_quality_classifier": (op2_quality_classifier, None),
    "op3_lm_scoring": (op3_lm_scoring, None),
    "op4_chat_formatting": (op4_chat_formatting, OP4_SQL),
    "op5_url_filters": (op5_url_filters, None),
    "op6_best_fit_packing": (op6_best_fit_packing, None),
    "op7_simhash_near_dedup": (op7_simhash_near_dedup, None),
    "op8_exact_topk_search": (op8_exact_topk_search, OP8_SQL),
    "op9_benchmark_decontamination": (op9_benchmark_decontamination, OP9_SQL),
    "op10_language_id": (op10_language_id, None),
    "op11_prefix_trie": (op11_prefix_trie, OP11_SQL),
    "op12_spelling_variants": (op12_spelling_variants, OP12_SQL),
    "op13_mixing": (op13_mixing, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
