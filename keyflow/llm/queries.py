"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyflow.llm import context_tree
from keyflow.llm.chat import CONTROLS, chat_digests, format_chats
from keyflow.llm.common import table
from keyflow.llm.decontamination import find_leaks
from keyflow.llm.edit_counts import edit_counts
from keyflow.llm.packing import pack_documents
from keyflow.llm.quality import quality_rules
from keyflow.llm.simhash import simhash_groups
from keyflow.llm.substring_dedup import kept_digest, substring_dedup
from keyflow.llm.token_store import read_tokens, write_tokens
from keyflow.llm.warc import read_warcs, write_warcs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, removed words, digest of the words kept."""
    out = substring_dedup(table(spark, sf_dir, "documents"), min_words=13)
    return out.select("doc_id", "dedup.n_words", "dedup.n_removed", kept_digest(F.col("text")).alias("kept_sha256"))


ORACLE_SQL["op1_substring_dedup"] = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w WHERE len(words) >= 13
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 12], ' ')) AS h FROM starts
), firsts AS (
  SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY h
), hit AS (
  SELECT windows.doc_id, windows.i FROM windows JOIN firsts USING (h) WHERE first_doc < windows.doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM hit) GROUP BY doc_id
), flat AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w
), removed AS (
  SELECT DISTINCT doc_id, unnest(places) AS p FROM gone
), kept AS (
  SELECT flat.doc_id, string_agg(word, ' ' ORDER BY flat.p) AS text, count(*) AS n
  FROM flat LEFT JOIN removed ON flat.doc_id = removed.doc_id AND flat.p = removed.p WHERE removed.p IS NULL GROUP BY flat.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the countable signs, and whether it is kept."""
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_low", "p_toxic")])


@_query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and benchmark item that occurs in it: edits, and where in the normalised text."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.edits", "leak.start", "leak.end")


@_query
def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base score and context-tree score."""
    docs = table(spark, sf_dir, "documents")
    scored = context_tree.score(docs, context_tree.fit(docs))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def tokenizer_path(name: str) -> str:
    """A tokenizer file's place; the files belong to the machine and aren't part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: where its ids begin among all, how many, and their checksum, read back from the shards."""
    shards = write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    n = (F.octet_length("ids") / 4).cast("long")
    return read_tokens(shards).select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@_query
def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: its place in its document and in its sequence, and the checksum of its ids."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1, window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fingerprint and component."""
    return simhash_groups(table(spark, sf_dir, "documents"), radius=4, shingle=4, seed=42)


@_query
def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens before and after three edits, and how many of its stretches these re-encoded."""
    return edit_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: what its record says, read back from the archives."""
    return read_warcs(write_warcs(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op9_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@_query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: digests of its turns and of what is learnt, read back from the formatted text."""
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_digests(format_chats(turns))


def _guarded(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE_SQL["op10_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST] ' || {_guarded('text')} || ' [/INST]' WHEN 'assistant' THEN '<s>' || {_guarded('text')} || '</s>'
            ELSE '[ROLE]' || {_guarded('role')} || '[TEXT]' || {_guarded('text')} || '[/ROLE]' END AS shown FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(shown)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over documents; its pieces with the checksum of their ids."""
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, sf_dir)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
