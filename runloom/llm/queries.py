"""One query per operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import (
    bpe,
    conversation_trie,
    language_id,
    language_model,
    merkle_manifest,
    mixing,
    ngram_join,
    quality_classifier,
    quality_rules,
    sharding,
    topk,
    toxicity,
    warc,
)
from runloom.llm.common import crc_rest, ship, stored, table
from runloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tokenizer_path() -> str:
    """The vocabulary file as installed with the package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(ship(prepare(spark)), sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return run


@query
def op1_shard(spark, sf_dir):
    """All documents on a ring of 16 shards with bounded loads."""
    return sharding.place(table(spark, sf_dir, "documents"), shards=16)


@query
def op2_ngram_join(spark, sf_dir):
    """The near-copy group of every document: five-word shingles, similarity of 0.75 and more."""
    groups = ngram_join.near_groups(table(spark, sf_dir, "documents"), n=5, percent=75)
    return groups.select("doc_id", "n_shingles", "component_id")


@query
def op3_mix_sources(spark, sf_dir):
    """All documents mixed to weights 1, 2, 3 with at most 3 epochs of a source."""
    return mixing.score(table(spark, sf_dir, "documents"), weights=(1, 2, 3), share=1.0, max_epochs=3)


@query
def op4_top_k(spark, sf_dir):
    """The 5 best candidates of every 50th vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


@query
def op5_bpe(spark, sf_dir):
    """Digests of the ids and of the decoded text of every document."""
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op6_warc(spark, sf_dir):
    """All pages written as archives and read back from the stored archives."""
    archives = stored(warc.write(table(spark, sf_dir, "pages"), min_bytes=0), "warc")
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query
def op7_toxicity(spark, sf_dir):
    """The toxicity of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_quality_rules(spark, sf_dir):
    """Word measures and the verdict of the line rules for every document."""
    return quality_rules.score(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )


@query
def op9_quality(spark, sf_dir):
    """The quality of every document."""
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_language_model(spark, sf_dir):
    """All texts under the model of those that are not held out."""
    return language_model.score(table(spark, sf_dir, "documents"))


@query
def op11_conversation_trie(spark, sf_dir):
    """All prefixes of the conversations after each took its first turns from the first of its group of five."""
    turns = stored(conversation_trie.turns_of(table(spark, sf_dir, "conversations")), "turns")
    rebuilt, lengths = conversation_trie.branched(turns, group=5, head=F.crc32(F.col("conv_id").cast("string")) % 9, most=8)
    nodes, ends = conversation_trie.trie(stored(rebuilt, "rebuilt"), lengths)
    return conversation_trie.described(nodes, ends).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"), "ends_sha256"
    )


@query
def op12_merkle_manifest(spark, sf_dir):
    """The manifest of all documents by source, and what the proofs say of texts of which a fifth was lower-cased afterwards."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = merkle_manifest.leaf([*fields, F.translate("text", upper, upper.lower())])
    rows = docs.select(
        merkle_manifest.group_key(F.col("source")).alias("g"), F.col("doc_id").cast("long").alias("id"),
        merkle_manifest.leaf([*fields, F.col("text")]).alias("leaf"), F.when(crc_rest(F.col("doc_id"), 5) == 0, tampered).alias("claimed"),
    )
    rows = stored(rows.withColumn("claimed", F.coalesce("claimed", "leaf")), "leaves")
    proofs = merkle_manifest.manifest(rows, {"claimed": "binary"})
    return merkle_manifest.verified(proofs, "claimed").select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op13_language_id(spark, sf_dir):
    """The language of every document."""
    return language_id.score(table(spark, sf_dir, "documents"))


__all__ = ["QUERIES"]
