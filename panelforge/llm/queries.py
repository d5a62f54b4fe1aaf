"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup, normalised
from .jaccard import jaccard_classes
from .language import fit_languages, held_out, identify
from .lm_scores import score_documents
from .mixing import mix_counts
from .neighbours import nearest
from .pieces import encode_pieces
from .secrets import linked_pairs, listed, scan
from .sharding import shard
from .token_files import read_digests, write_tokens


def _documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cols)


def tokenizer(name: str) -> str:
    """A vocabulary file of the public tokenizers; the folder is ``PUBLIC_TOKENIZERS`` or the installed package's."""
    import os

    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_documents(spark, sf_dir, "doc_id", "text")).drop("n_copies")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(_documents(spark, sf_dir, "doc_id", "text"))
    base = F.sha2(listed(F.filter("spans", lambda s: s["base"])), 256)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), listed(F.col("spans")).alias("spans"), linked_pairs(F.col("spans")).alias("links"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    out = encode_pieces(docs, tokenizer("piece_bpe_32k.model"))
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.xxhash64("begins", "ends").alias("spans_xxhash64"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_counts(_documents(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_documents(spark, sf_dir, "doc_id", "text"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(_documents(spark, sf_dir, "doc_id", "text"), tokenizer("word_bpe_49k.json"), vocabulary=49_408, end_id=2)
    return read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit_languages(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _documents(spark, sf_dir, "doc_id", "text")
    docs = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard(docs, shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The digest is made before rows are joined, so no text is shuffled.
    docs = _documents(spark, sf_dir, "doc_id", "text").withColumn("text_sha256", F.sha2(normalised(F.col("text")), 256))
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {
    "op1_jaccard": op1_jaccard,
    "op2_secrets": op2_secrets,
    "op3_pieces": op3_pieces,
    "op4_mixing": op4_mixing,
    "op5_lm_scores": op5_lm_scores,
    "op6_neighbours": op6_neighbours,
    "op7_token_files": op7_token_files,
    "op8_language": op8_language,
    "op9_sharding": op9_sharding,
    "op10_exact_dedup": op10_exact_dedup,
}

_TEXT_N = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

ORACLES = {
    "op5_lm_scores": r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
t AS (SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS i FROM w WHERE len(l) > 0),
u AS (SELECT word AS id, count(*) AS times FROM t GROUP BY 1),
n AS (SELECT sum(times) AS n FROM u),
b AS (SELECT doc_id, i, word AS w2, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS w1 FROM t),
bc AS (SELECT w1, w2, count(*) AS times FROM b WHERE w1 IS NOT NULL GROUP BY 1, 2),
s AS (
  SELECT b.doc_id, CAST(round(1e6 * CASE WHEN b.w1 IS NULL THEN ln(u2.times) - ln(n.n) WHEN bc.times >= 2 THEN ln(bc.times) - ln(u1.times) ELSE ln(0.4) + ln(u2.times) - ln(n.n) END) AS BIGINT) AS m
  FROM b JOIN u u2 ON b.w2 = u2.id LEFT JOIN u u1 ON b.w1 = u1.id LEFT JOIN bc ON b.w1 = bc.w1 AND b.w2 = bc.w2 CROSS JOIN n)
SELECT w.doc_id, len(l) AS n_words, coalesce(m, 0) / 1e6 AS score, CASE WHEN len(l) > 0 THEN m / 1e6 / len(l) END AS per_word
FROM w LEFT JOIN (SELECT doc_id, CAST(sum(m) AS BIGINT) AS m FROM s GROUP BY 1) USING (doc_id)""",
    "op10_exact_dedup": f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS c, sha256({_TEXT_N}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size FROM d GROUP BY 1),
k AS (SELECT text_sha256, doc_id AS keep_id FROM d QUALIFY row_number() OVER (PARTITION BY text_sha256 ORDER BY c DESC, doc_id) = 1)
SELECT d.doc_id, k.keep_id, g.group_size, d.doc_id = k.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256) JOIN k USING (text_sha256)""",
}
