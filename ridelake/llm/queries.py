"""The registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake.llm import bpe, contamination, embeddings, lines, merkle, quality, repair, secrets, simhash, substrings, suffixes, toxicity, warc
from ridelake.llm.common import stage, table


#: The columns a leaf of the manifest covers.
MERKLE_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The vocabulary file and the pattern of its pre-tokens.
VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("url")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _damaged(turns: DataFrame) -> DataFrame:
    """Conversations with turns dropped, emptied, cut short, repeated or given to the user, by a checksum of their key."""
    turns = turns.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.filter("kind != 0").withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("kind", "copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults, the cheapest repair and a digest of what it makes of them."""
    turns = table(spark, sf_dir, "conversations")
    damaged = _damaged(turns)
    found = stage(repair.edits(damaged), "edits")
    digests = repair.text_digests(repair.repaired(damaged, found))
    rows = turns.select(F.col("conv_id").alias("c")).distinct()
    for more in (found, digests):
        rows = rows.join(more, F.col("c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select(
        F.col("c").alias("conv_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, and whether they hold for a copy in which some documents were tampered with."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = merkle.leaf_hash(*(F.col(c) + F.when(hit, 1).otherwise(0) if c == "n_chars" else F.col(c) for c in MERKLE_COLUMNS))
    rows = merkle.manifest(docs.withColumn("claimed", claimed), MERKLE_COLUMNS, "lang", "doc_id", also=["claimed"])
    rows = rows.withColumn("folded_root", merkle.folded(F.col("claimed"), F.col("proof")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op2_secret_scan": op2_secret_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_warc_round_trip": op9_warc_round_trip,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def _crc32(text: str) -> str:
    """SQL for the crc32 of an ASCII text by the table ``crc``, of which a query has a row."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1])), 4294967295)"


#: Fixed value: the reversed polynomial of crc32.
_CRC_TABLE = """
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
"""

#: Fixed value: what stands between words.
_BLANK = "[\\x20\\x09-\\x0D]"

SQL = {
    "op12_substring_dedup": f"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '') AS w FROM documents
        ), p AS (
            SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
        ), s AS (
            SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN md5(array_to_string(w[i:i + 19], ' ')) END AS wind FROM p
        ), l AS (
            SELECT *, wind IS NOT NULL AND row_number() OVER (PARTITION BY wind ORDER BY doc_id, i) > 1 AS later FROM s
        ), c AS (
            SELECT doc_id, i, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM l
        ), k AS (
            SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id
    """,
    "op11_conversation_repair": f"""
        WITH RECURSIVE t AS ({_CRC_TABLE}), k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
            FROM conversations, t
        ), d AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM k WHERE kind <> 0
        ), o AS (
            SELECT *, left(role, 1) AS x, regexp_extract(text, '([^\\x20\\x09-\\x0D]){_BLANK}*$', 1) AS tail,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again
            FROM d
        ), f AS (
            SELECT *, CASE WHEN tail = '' THEN 1 WHEN again THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS pos,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS y
            FROM o
        ), c AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
                   count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
                   count(*) FILTER (pos > 1 AND y || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM f GROUP BY conv_id
        ), step(p, e, q, letter) AS (
            VALUES (0, 'K', 1, 's'), (0, 'K', 2, 'u'), (1, 'K', 2, 'u'), (2, 'K', 3, 'a'), (3, 'K', 2, 'u'),
                   (0, 'R', 2, 'u'), (1, 'R', 2, 'u'), (2, 'R', 3, 'a'), (3, 'R', 2, 'u'), (0, 'D', 0, ''), (1, 'D', 1, ''), (2, 'D', 2, ''), (3, 'D', 3, '')
        ), ins(p, q, cost, audit, body) AS (
            VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
                   (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'assistant:'), (3, 2, 3, 'I', chr(10) || 'user:'),
                   (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
        ), r(conv_id, i, q, w) AS (
            SELECT conv_id, 0::BIGINT, 0, {{'cost': 0, 'audit': '', 'body': ''}} FROM c
            UNION ALL
            SELECT r.conv_id, r.i + 1, step.q, min({{
                'cost': r.w.cost + ins.cost + CASE step.e WHEN 'K' THEN 0 WHEN 'R' THEN 3 ELSE 4 END + CASE WHEN f.fault = 3 AND step.e <> 'D' THEN 3 ELSE 0 END,
                'audit': r.w.audit || ins.audit || step.e,
                'body': r.w.body || ins.body || CASE WHEN step.e = 'D' THEN '' ELSE chr(10) || CASE WHEN step.e = 'K' THEN f.role WHEN step.q = 2 THEN 'user' ELSE 'assistant' END || ':' || f.text END
            }})
            FROM r JOIN ins ON ins.p = r.q JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.i + 1
            JOIN step ON step.p = ins.q AND (step.e <> 'K' OR step.letter = f.x) AND (step.e = 'D' OR f.fault IN (0, 3))
            GROUP BY r.conv_id, r.i, step.q
        ), best AS (
            SELECT r.conv_id, min({{'cost': r.w.cost + ins.cost, 'audit': r.w.audit || ins.audit, 'body': r.w.body || ins.body}}) AS w
            FROM r JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = c.n JOIN ins ON ins.p = r.q AND ins.q IN (0, 3)
            GROUP BY r.conv_id
        )
        SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(w.cost, 0) AS BIGINT) AS cost,
               coalesce(w.audit, '') AS audit, sha256(coalesce(w.body[2:], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
        LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id
    """,
    "op13_merkle_manifest": f"""
        WITH RECURSIVE t AS ({_CRC_TABLE}), d AS (
            SELECT doc_id, lang, n_chars, coalesce({_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0, false) AS hit,
                   coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
                   || coalesce(octet_length(encode(source)) || ':' || source, '-')
                   || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
                   coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
            FROM documents, t
        ), leaf AS (
            SELECT doc_id, lang, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
                   sha256(head || coalesce(length(CAST(n_chars + hit::INT AS VARCHAR)) || ':' || (n_chars + hit::INT), '-') || tail) AS claimed
            FROM d
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf
        ), low(lang, lvl, pos, n, h) AS (
            SELECT lang, 0, pos::BIGINT, n::BIGINT, leaf FROM placed
            UNION ALL
            SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lang, lvl, pos // 2, n
        ), subs AS (
            SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, lvl AS top FROM low WHERE n = 1
        ), high(lvl, pos, n, h) AS (
            SELECT 0, pos::BIGINT, n::BIGINT, subroot FROM subs
            UNION ALL
            SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 2, n
        ), fold(doc_id, lang, leaf, node, lvl, pos, n, proof, upper) AS (
            SELECT doc_id, lang, leaf, claimed, 0, pos::BIGINT, n::BIGINT, '', false FROM placed
            UNION ALL
            SELECT f.doc_id, f.lang, f.leaf,
                   CASE WHEN f.n = 1 THEN f.node WHEN f.pos % 2 = 1 THEN sha256(coalesce(l.h, u.h, '') || f.node) ELSE sha256(f.node || coalesce(l.h, u.h, '')) END,
                   CASE WHEN f.n = 1 THEN 0 ELSE f.lvl + 1 END,
                   CASE WHEN f.n = 1 THEN s.pos ELSE f.pos // 2 END, CASE WHEN f.n = 1 THEN s.n ELSE (f.n + 1) // 2 END,
                   f.proof || CASE WHEN f.n = 1 THEN '' ELSE coalesce(l.h, u.h, '') END, f.upper OR f.n = 1
            FROM fold f JOIN subs s ON f.lang IS NOT DISTINCT FROM s.lang
            LEFT JOIN low l ON NOT f.upper AND f.n > 1 AND l.lang IS NOT DISTINCT FROM f.lang AND l.lvl = f.lvl AND l.pos = xor(f.pos, 1)
            LEFT JOIN high u ON f.upper AND f.n > 1 AND u.lvl = f.lvl AND u.pos = xor(f.pos, 1)
            WHERE f.n > 1 OR NOT f.upper
        )
        SELECT f.doc_id, f.leaf, s.subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = r.h AS verified
        FROM fold f JOIN subs s ON f.lang IS NOT DISTINCT FROM s.lang, (SELECT h FROM high WHERE n = 1) r
        WHERE f.upper AND f.n = 1
    """,
    "op6_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
        ), l AS (
            SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
        ), r AS (
            SELECT vec_id AS i, vec_id AS j FROM embeddings
            UNION
            SELECT r.i, l.j FROM r JOIN l ON r.j = l.i
        ), c AS (
            SELECT i, min(j) AS component_id FROM r GROUP BY i
        )
        SELECT c.i AS vec_id, CAST((SELECT count(*) FROM l WHERE l.i = c.i) AS BIGINT) AS n_links,
               component_id, c.i = component_id AS kept
        FROM c
    """,
    "op4_line_dedup": """
        WITH d AS (
            SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
        ), l AS (
            SELECT source, unnest(ls) AS line FROM d
        ), b AS (
            SELECT trim(line) AS line FROM l
            WHERE source IS NOT NULL AND trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10
        ), k AS (
            SELECT doc_id, ls, list_filter(ls, lambda x: NOT list_contains(bad, trim(x))) AS kept
            FROM d CROSS JOIN (SELECT coalesce(list(line), []) AS bad FROM b)
        )
        SELECT doc_id, CAST(len(list_filter(ls, lambda x: trim(x) <> '')) AS BIGINT) AS n_lines,
               CAST(len(ls) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, chr(10))) AS kept_sha256
        FROM k
    """,
    "op9_warc_round_trip": """
        WITH p AS (
            SELECT page_id, sha256(coalesce(html, '')) AS payload_digest,
                   CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
            FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
}
