"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, counts, crosstok, embed, imatch, packing, pii, secrets, simhash, suffix, toxicity
from .common import hex_digest, of_kinds, span_string

QUERIES: dict = {}
#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer() -> tuple[str, str]:
    """(rank file, pattern) of the public multilingual vocabulary; $TOKENIZER_RANKS names another file."""
    import public_tokenizers

    path = os.environ.get("TOKENIZER_RANKS") or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, public_tokenizers.PATTERN


def byte_level() -> str:
    """The public byte-level BPE file; $TOKENIZER_BYTE_LEVEL names another."""
    import public_tokenizers

    return os.environ.get("TOKENIZER_BYTE_LEVEL") or public_tokenizers.path("byte_bpe_50k.json")


def pieces() -> str:
    """The public model of pieces; $TOKENIZER_PIECES names another."""
    import public_tokenizers

    return os.environ.get("TOKENIZER_PIECES") or public_tokenizers.path("piece_bpe_32k.model")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"), *tokenizer())


@query
def op2_secrets(spark, sf_dir):
    found = secrets.scan(read(spark, sf_dir, "documents"), *tokenizer())
    return found.select(
        "doc_id",
        *[F.size(of_kinds(F.col("spans"), [k])).cast("long").alias(f"n_{k}") for k in secrets.KINDS],
        hex_digest(span_string(of_kinds(F.col("spans"), secrets.BASE_KINDS))).alias("base_sha256"),
        span_string(F.col("spans")).alias("spans"),
    )


@query
def op3_chat(spark, sf_dir):
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    conv, turn = given.schema["conv_id"].dataType.simpleString(), given.schema["turn"].dataType.simpleString()
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], f"conv_id {conv}, turn {turn}, role string, text string")
    return chat.summary(chat.windows(given.unionByName(extra), *tokenizer()))


@query
def op4_imatch(spark, sf_dir):
    return imatch.match(read(spark, sf_dir, "documents"))


@query
def op5_bpe(spark, sf_dir):
    path, pattern = tokenizer()
    coded = bpe.round_trip(read(spark, sf_dir, "documents"), path, pattern)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"),
    )


@query
def op6_pii(spark, sf_dir):
    found = pii.scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(of_kinds(F.col("spans"), [k])).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        hex_digest(span_string(of_kinds(F.col("spans"), pii.BASE_KINDS))).alias("base_sha256"),
        span_string(F.col("spans")).alias("spans"),
    )


@query
def op7_simhash(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_embeddings(spark, sf_dir):
    return embed.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op9_suffix(spark, sf_dir):
    found = suffix.deduplicate(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op11_crosstok(spark, sf_dir):
    return crosstok.align_documents(read(spark, sf_dir, "documents"), byte_level(), pieces(), tokenizer()[1])


@query
def op12_counts(spark, sf_dir):
    counted = counts.token_counts(read(spark, sf_dir, "documents"), byte_level(), tokenizer()[1])
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op13_audit(spark, sf_dir):
    return audit.audit(read(spark, sf_dir, "documents"))


ORACLES["op13_audit"] = r"""
WITH words AS (
    SELECT row_id, lang, source, unnest(list) AS term
    FROM (
        SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS list
        FROM documents
    )
),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10),
groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counted AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
total AS (SELECT lang, source, sum(n) AS total FROM counted GROUP BY ALL),
share AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0)::HUGEINT + 2 * z.v) AS p
    FROM groups g JOIN kept k ON g.lang = k.lang JOIN size z ON g.lang = z.lang
    LEFT JOIN total t ON g.lang = t.lang AND g.source = t.source
    LEFT JOIN counted c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
),
whole AS (SELECT lang, term, sum(n) AS n FROM counted GROUP BY ALL),
lang_share AS (
    SELECT w.lang, w.term, 1 + (1000000000::HUGEINT * (w.n + 2)) // (t.total::HUGEINT + 2 * z.v) AS q
    FROM whole w JOIN size z ON w.lang = z.lang JOIN (SELECT lang, sum(n) AS total FROM whole GROUP BY lang) t ON w.lang = t.lang
),
apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
),
terms AS (
    SELECT s.lang, s.source, 'term' AS part, s.term AS item, ((s.p - l.q) * (s.p - l.q)) // (s.p + l.q) AS value
    FROM share s JOIN lang_share l ON s.lang = l.lang AND s.term = l.term WHERE s.n > 0 AND s.p > l.q
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
