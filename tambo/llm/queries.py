"""The registered queries of this subpackage (opN_<name>) and their DuckDB SQL where SQL can express them.

Each query runs its operator with production parameters over the whole table and derives the digest columns of its
contract from the operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tambo.llm import (chat, decontaminate, langid, lcp, lexical, licenses, packing, prefix_trie, sharding, simhash, token_counts,
                       toxicity, warc)
from tambo.llm.common import read_table

CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumnRenamed("doc", "doc_id")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit(CONTROL_TEXT).alias("text"))
    done = chat.format_conversations(rows.unionByName(planted))
    back = done.withColumns({"turns": chat.read_back(F.col("formatted")),
                             "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


def op5_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), k=3, max_bits=3)
    return found.select(F.col("doc").alias("doc_id"), simhash.as_hex(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcp.edited_likeness(read_table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shuffle_into_shards(rows, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), "held_out", "lang_pred", "score")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048)
    return packed.withColumnRenamed("doc", "doc_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)
    return found.select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = prefix_trie.turn_paths(read_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(paths)).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select(F.col("doc").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_license_scan, op3_token_counts, op4_chat_format, op5_simhash_near_dups,
    op6_document_fingerprints, op7_sharding, op8_language_id, op9_best_fit_packing, op10_warc,
    op11_lexical_search, op12_prefix_trie, op13_toxicity)}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, least(13, len(w)) AS k FROM i WHERE len(w) > 0),
p AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS pos0 FROM s),
iw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, pos0, pos0 + k - 1), ' ') AS win FROM p),
ks AS (SELECT DISTINCT k FROM iw),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS pos0 FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, k, pos0, array_to_string(list_slice(w, pos0, pos0 + k - 1), ' ') AS win FROM dp),
hit AS (SELECT doc_id, pos0, dw.k, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
pos AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(pos0, pos0 + k)) AS q FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""",
    "op4_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')),
e AS (SELECT *, length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS text_len,
             length(replace(replace(role, '\\', '\\\\'), '<|', '<\\|')) AS role_len,
             coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS more FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(text_len + CASE WHEN more THEN {len(chat.CONT)} ELSE role_len + {len(chat.START + chat.SEP + chat.CLOSE)} END)::BIGINT
           AS formatted_chars
FROM e GROUP BY conv_id""",
    "op10_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < largest THEN largest END AS refers_to,
       CASE WHEN page_id < largest THEN 0 ELSE payload_bytes END::BIGINT AS block_bytes
FROM r""",
    "op11_lexical_search": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, row_number() OVER () AS r, {_WORDS} AS w FROM benchmark),
s AS (SELECT count(*) AS N, sum(len(w)) AS L FROM d WHERE len(w) > 0),
dt AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
it AS (SELECT r, term, count(*) AS q FROM (SELECT r, unnest(w) AS term FROM i) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM dt WHERE term IN (SELECT term FROM it) GROUP BY term),
wt AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS wt FROM df, s),
m AS (SELECT r, doc_id, (25 + (75 * len(w) * N) // L)::BIGINT AS m FROM d, s WHERE len(w) > 0),
sc AS (SELECT it.r AS item, dt.r AS doc, sum(q * wt * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
       FROM it JOIN wt USING (term) JOIN dt USING (term) JOIN m ON m.r = dt.r GROUP BY it.r, dt.r),
rk AS (SELECT item, m.doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, m.doc_id NULLS LAST) AS rk
       FROM sc JOIN m ON m.r = sc.doc WHERE score > 0)
SELECT i.item_id, rk::INTEGER AS rank, doc_id, score FROM rk JOIN i ON i.r = rk.item WHERE rk <= 10""",
    "op12_prefix_trie": """
WITH b AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)
                       ORDER BY i) AS tab FROM range(256) r(i)),
t AS (SELECT conv_id AS c, turn, length(coalesce(text, '')) AS n, coalesce(role, '') AS r, coalesce(text, '') AS x
      FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, turn, n, substr(sha256(concat(length(r), ':', r, x)), 1, 32) AS id FROM t),
o AS (SELECT c, list({'id': id, 'n': n} ORDER BY turn NULLS FIRST, id, n) AS ids FROM k GROUP BY c),
h AS (SELECT c, ids, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda y: ascii(y)::BIGINT)),
             lambda a, y: xor(a // 256, tab[xor(a, y) % 256 + 1])), 4294967295) % 6 AS h FROM o, b),
e AS (SELECT h.c, list_concat(list_slice(coalesce(o.ids, []), 1, h.h), list_slice(h.ids, h.h + 1, len(h.ids))) AS ids
      FROM h LEFT JOIN o ON o.c = h.base),
m AS (SELECT c, len(ids) AS total, d, list_slice(ids, 1, d) AS p FROM (SELECT c, ids, unnest(range(0, len(ids) + 1)) AS d FROM e)),
n AS (SELECT d, p, min(c) AS conv, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE p[d].n END AS size,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (total = d), '')) AS ends FROM m GROUP BY d, p),
g AS (SELECT d - 1 AS d, list_slice(p, 1, d - 1) AS p, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(kids, 0) AS kids, unnest(range(0, n.d + 1)) AS above FROM n LEFT JOIN g ON g.d = n.d AND g.p = n.p),
s AS (SELECT above AS d, list_slice(p, 1, above) AS p, sum((n - 1) * size) AS saved, count(*) FILTER (kids = 0) AS leaves FROM a GROUP BY ALL)
SELECT n.conv AS conv_id, n.d AS depth, u.conv AS parent_conv_id, n.n AS n_convs, coalesce(g.kids, 0) AS n_children,
       s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s ON s.d = n.d AND s.p = n.p LEFT JOIN g ON g.d = n.d AND g.p = n.p
LEFT JOIN n u ON u.d = n.d - 1 AND u.p = list_slice(n.p, 1, n.d - 1)""",
}
