"""Registered queries of the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .alignment import align_documents
from .chat import conversation_digests, format_conversations
from .common import word_array
from .exact import exact_copies
from .interpolation import score_texts
from .mixing import mix_sources
from .ngram_join import similar_sets
from .periodic import periodic_runs
from .phrases import remove_repeats
from .pieces import encoded_digests
from .quality import quality_verdicts
from .secret_scan import ALLOWED, CLASSES, MIXED, find_secrets, span_text
from .sharding import balanced_tree, shard_rows
from .token_counts import section_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; ``TOKENIZERS`` names another folder."""
    folder = os.environ.get("TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_entropy_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "rate", (F.col("copies") * F.col("size")).alias("taken"))


@query("op2_repeat_automata")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)


@query("op3_hash_tree")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(table(spark, sf_dir, "documents"), balanced_tree(8), balanced_tree(9))
    return placed.withColumn("law", F.lit("key"))


@query("op4_deleted_interpolation")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]')) AS wide,
  length(role) + len(regexp_extract_all(role, '\\|</?s>|\[/?INST\]')) AS wide_role FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN 17 + wide ELSE 18 + wide_role + wide END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


@query("op5_chat_template", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return conversation_digests(format_conversations(turns.unionByName(planted)))


@query("op6_robust_outliers")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_verdicts(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


@query("op7_prefix_tree")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""


@query("op8_exact_copies", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("keep_key").alias("keep_id"), "group_size", "kept", "text_sha256")


@query("op9_piece_offsets")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op10_section_tokens")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


@query("op11_pointer_groups")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.withColumn("groups_sha256", digest).drop("groups")


def planted_periods(df: DataFrame) -> DataFrame:
    """Documents in which the words behind a prefix of some repeat with a period, by the checksum of ``doc_id`` (fixed rule)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = df.withColumn("g", F.floor(h / 10)).withColumn("words", F.when(h % 10 == 0, word_array(F.col("text"))))
    words = words.withColumn("words", F.when(F.size("words") > 0, F.col("words")))
    n = F.size("words")
    placed = words.withColumn("a", (F.col("g") % n).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return placed.select("doc_id", F.when(F.col("words").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_synchronised_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    longer = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda b, r: F.when(longer(b, r), r).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    ended = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(ended.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def _op13_sql() -> str:
    """Matches placed by summing the text between them, and every window of every candidate weighed by itself."""
    word = "".join
    either = lambda w: word(f"[{c.upper()}{c}]" for c in w)
    assign = "(" + "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + "|" + either("api") + "_?" + either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    hits = [("assign", assign, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]
    hits += [(c.kind, c.pattern, 0, c.window) for c in CLASSES]

    def found(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
        quoted = pattern.replace("'", "''")
        return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS text, CAST(list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda m: length(m))), 0) AS BIGINT) AS start
          FROM (SELECT doc_id, gaps, ms, unnest(ms) AS s, unnest(vs) AS v, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '{quoted}') AS gaps,
            regexp_extract_all(text, '{quoted}') AS ms, regexp_extract_all(text, '{quoted}', {group}) AS vs FROM d)) WHERE length(v) >= {least}"""

    everything = " UNION ALL ".join(found(r, *h) for r, h in enumerate(hits))
    rejected = " OR ".join(f"regexp_matches(text, '{p}')" for p in ALLOWED)
    limits = " ".join(f"WHEN '{c.kind}' THEN {c.bits}" for c in CLASSES)
    without = " ".join(f"WHEN '{c.kind}' THEN regexp_matches(text, '{c.without}')" for c in CLASSES)
    width = CLASSES[0].window
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), hits AS MATERIALIZED ({everything}),
  base AS (SELECT doc_id, rank, kind, start, start + length(text) AS stop FROM hits WHERE rank < 3),
  windows AS (SELECT doc_id, rank, kind, start, i, list_aggregate(string_split(substring(text, CAST(i AS BIGINT), {width}), ''), 'entropy') AS bits
    FROM (SELECT *, unnest(range(1, length(text) - {width - 2})) AS i FROM hits WHERE rank >= 3 AND regexp_matches(text, '{MIXED}') AND NOT ({rejected}) AND NOT CASE kind {without} END)),
  dense AS (SELECT doc_id, rank, kind, min(start + i - 1) AS start, max(start + i - 1 + {width}) AS stop FROM windows WHERE bits >= CASE kind {limits} END GROUP BY doc_id, rank, kind, start),
  every AS (SELECT * FROM base UNION ALL SELECT * FROM dense a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND b.stop >= a.stop)),
  listed AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM every GROUP BY doc_id)
  SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (doc_id)"""


@query("op13_window_entropy", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(F.array_sort(F.concat("base", "added"))).alias("spans"))
