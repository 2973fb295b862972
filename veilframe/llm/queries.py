"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.sql import col, fn

from . import (
    conversation_repair,
    exact_dedup,
    html_extract,
    ngram_join,
    packing,
    pii_votes,
    piece_bpe,
    quality_lists,
    sharding,
    token_alignment,
    token_counts,
    token_files,
    toxicity,
)
from .common import settled, shared_path

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_chosen_path_join",
    r"""WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
          SELECT DISTINCT doc_id, unnest(
            CASE WHEN len(w) >= 5
                 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
          FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
                   FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b, c = x.n AND c = y.n AS same
                  FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
                  WHERE 5 * c >= 4 * (x.n + y.n - c)),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        class AS (SELECT a, min(least(a, b)) AS class_id FROM reach GROUP BY a),
        copy AS (SELECT d.doc_id, least(d.doc_id, min(l.b)) AS copy_id
                 FROM documents d LEFT JOIN links l ON l.a = d.doc_id AND l.same GROUP BY d.doc_id)
        SELECT d.doc_id, coalesce(any_value(k.class_id), d.doc_id) AS class_id, any_value(c.copy_id) AS copy_id,
               count(l.b) AS n_links,
               count(DISTINCT CASE WHEN NOT l.same THEN o.copy_id END) AS n_partners
        FROM documents d JOIN copy c ON c.doc_id = d.doc_id LEFT JOIN class k ON k.a = d.doc_id
             LEFT JOIN links l ON l.a = d.doc_id LEFT JOIN copy o ON o.doc_id = l.b
        GROUP BY d.doc_id""",
)
def op1_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "copy_id", "n_links", "n_partners")


@query(
    "op2_page_differencing",
    r"""WITH body AS (
          SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS b
          FROM pages),
        bare AS (
          SELECT page_id, url,
                 regexp_replace(regexp_replace(b, '</?(?:p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t
          FROM body),
        decoded AS (
          SELECT page_id, url, trim(regexp_replace(
            regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(t, '&#x27;', chr(39)),
              '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
            '\s+', ' ', 'g')) AS text
          FROM bare)
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM decoded""",
)
def op2_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


#: The end of a document in the contracts of packing and token files.
END_ID = 2


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_pii_votes")
def op5_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the texts are read once: what is found in them is small and kept
    spans = settled(pii_votes.found(docs, "text", "found").select("doc_id", "found"), "spans")
    model = pii_votes.fit(spans, "found")
    found = col("found")
    count = {
        f"n_{kind}": fn.size(pii_votes.of_kind(found["base"], kind)).cast("bigint")
        for kind in pii_votes.KINDS
    }
    return spans.select(
        "doc_id",
        *[value.column().alias(name) for name, value in count.items()],
        fn.sha2(pii_votes.joined(found["base"]), 256).column().alias("base_sha256"),
        pii_votes.joined(pii_votes.all_spans(found, model)).column().alias("spans"),
    )


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = shared_path(spark, "token-files")
    token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"), folder, END_ID)
    found = token_files.read(spark, folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query(
    "op7_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
              doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.flagged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op8_piece_bpe")
def op8_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = piece_bpe.encode_frame(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_lists.fit(docs, table(spark, sf_dir, "labels"))
    found = quality_lists.judged(docs, rules)
    return found.select("doc_id", *quality_lists.COUNTS, "base_failed", "kept")


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by two tokenizers, aligned over its bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    byte_bpe, piece_bpe = map(
        public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")
    )
    return token_alignment.align(docs, byte_bpe, piece_bpe)


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged, and repaired at the least cost."""
    return conversation_repair.repair(table(spark, sf_dir, "conversations"), damage=True)


@query("op13_toxic_segments")
def op13_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, model)
    return found.select(
        "doc_id",
        (toxicity.fold("doc_id") == 0).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
    )
