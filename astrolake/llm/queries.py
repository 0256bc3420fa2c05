"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolake.llm import (
    alignment, ann, bpe, chat_format, decontaminate, divergence, langid, line_dedup, packing, pii,
    simhash, topk, vectors, warc,
)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and digest both."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(texts, "text", RANKS, public_tokenizers.PATTERN).drop("text")
    decoded = bpe.decode(encoded, "ids", RANKS)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines, as counts and a digest of the text left."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = line_dedup.drop_recurring_lines(
        documents.withColumn("before", F.size(F.split("text", "\n"))), "doc_id", "text")
    return both.select(
        "doc_id", F.coalesce("before", F.lit(0)).cast("long").alias("n_lines"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


@query
def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC archives, with an index, and read every record back by its range."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = warc.write_archives(pages, "page_id", "url", "html")
    return warc.read_records(index, payloads=False).select(
        F.col("_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    )


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one of control strings; read turns and loss text back."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("""SELECT * FROM VALUES
        (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')
        AS t(conv_id, turn, role, text)""")
    records = chat_format.records_of_rows(
        conversations.unionByName(extra), "conv_id", "turn", "role", "text")
    formatted = chat_format.render(chat_format.canonical_turns(records, "record"))
    text, loss = F.col("formatted"), F.col("loss")
    read = formatted.select(
        "conv_id", "formatted", chat_format.read_turns(text).alias("turns"),
        chat_format.read_loss(text, loss).alias("learned"),
    )
    joined = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op5_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector by inner product, from the kd-tree of projections."""
    rows = vectors.uniform(
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", zero=False)
    return ann.neighbours(rows, query_every=20, k=20)


@query
def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and all spans of personal data in every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pii.train(documents, "text")
    found = pii.find(documents, "text", model)

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id", *(_count(kind) for kind in pii.KINDS),
        F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def _count(kind: str) -> Column:
    same = F.filter("base_spans", lambda span: span["kind"] == kind)
    return F.size(same).cast("long").alias(f"n_{kind}")


@query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every 50th vector with all other vectors."""
    rows = vectors.uniform(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", mixed=True)
    whole = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * 256)).alias("v"))
    return topk.top_k(whole, F.col("vec_id") % 50 == 0, 5)


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, links of at most 2 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", 3, 2)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the rows that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(documents, "doc_id", "text", "lang")
    predicted = langid.predict(documents.select("doc_id", "text"), "text", model)
    return predicted.select("doc_id", langid.held_out("doc_id").alias("held_out"),
                            "lang_pred", "score")


@query
def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, neighbours of the Hilbert curve together."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(documents, "doc_id", "text", TOKENIZER)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between the sources of every language, and the terms that set a source apart."""
    documents = table(spark, sf_dir, "documents").select("text", "lang", "source")
    return divergence.audit(documents, "text", "lang", "source")


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two public tokenizers in every document, and their counts."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(documents, "text", TOKENIZER, PIECES, keep=["doc_id"]).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a passage of the benchmark, and the items met."""
    found = decontaminate.contaminated_spans(
        table(spark, sf_dir, "documents").select("doc_id", "text"), "text",
        table(spark, sf_dir, "benchmark"), "item_id", "text")
    joined = F.array_join("items", ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(joined.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
