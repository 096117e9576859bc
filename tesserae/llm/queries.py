"""Registered queries of this package: thin digests of each operator's output over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.llm import divergence, htmltext, langid, media, nearest, packing, piecewise, quality, simhash, substrings, toxicity, urls, whitening
from tesserae.llm import oracles
from tesserae.llm.frames import fold_of, prepare
from tesserae.sources.tables import table


#: Host and path rules of the URL query, longest first to win.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked) of pages whose path names a labelled document: blocked if it is toxic or of low quality."""
    named = pages.select("url", F.element_at(F.regexp_extract_all(urls.path_of(F.col("url")), F.lit(r"([0-9]{1,18})"), F.lit(1)), -1).cast("long").alias("doc_id"))
    bad = labels.groupBy("doc_id").agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("blocked"))
    return named.filter("doc_id IS NOT NULL").join(bad, "doc_id").select("url", "blocked")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: the list's rule, else the rules mined from labelled pages."""
    pages = table(prepare(spark), sf_dir, "pages").select("page_id", "url")
    mined = urls.mine(labelled_urls(pages, table(spark, sf_dir, "labels")))
    return urls.judge(pages, URL_RULES, mined).select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every embedding whose id is divisible by 20."""
    return nearest.search(table(prepare(spark), sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of every document: 3-word shingles, at most 2 differing bits."""
    found = simhash.near_duplicates(table(prepare(spark), sf_dir, "documents"), width=3, distance=2)
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows outside fold 0."""
    docs = table(prepare(spark), sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", (F.coalesce(fold_of(F.col("doc_id")), F.lit(0)) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside fold 0."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    found = toxicity.detect(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    score = F.col("toxic_score")
    return found.select(
        "doc_id", (F.coalesce(fold_of(F.col("doc_id")), F.lit(0)) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"),
    )


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate passages of at least 50 words between all documents, and whole copies."""
    return substrings.repeated_passages(table(prepare(spark), sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens."""
    return packing.pack(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the scored pieces of a public model and decoded again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    read = piecewise.decode(piecewise.encode(docs, model, "text", "ids"), model, "ids", "decoded")
    ids = F.col("ids")
    return read.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.size(ids).cast("long").alias("n_pieces"),
        F.crc32(F.array_join(ids, ",").cast("binary")).alias("ids_crc32"), (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(prepare(spark), sf_dir, "pages")
    found = htmltext.main_text(pages.select("page_id", "url", "html"), htmltext.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as 8-bit samples of a WAV file, whose type and payload are found again from the bytes alone."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), media.store_text("text").alias("media"), F.lit("image/png").alias("declared"))
    found = media.inspect(stored, "media", "declared")
    whole = F.col("media_whole")
    read = found.withColumn("payload", F.substring(F.col("media"), (whole["data_start"] + 1).cast("int"), whole["data_length"].cast("int")))
    tail = F.substring(F.col("payload"), -64, 64)
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.col("media_type"), media.sample_feature("payload"), F.concat(F.lit("embedded="), F.size("media_embedded").cast("string"))).alias("feature"),
        "declared_ok",
    )


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the log-likelihood ratio's verdict on every document."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    found = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_score", "kept")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and the terms each has more of."""
    return divergence.compare(table(prepare(spark), sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every embedding along the four leading components."""
    return whitening.whiten(table(prepare(spark), sf_dir, "embeddings"))


QUERIES = {
    "op1_urls": op1_urls, "op2_nearest": op2_nearest,
    "op3_simhash": op3_simhash, "op4_toxicity": op4_toxicity, "op5_packing": op5_packing, "op6_language": op6_language, "op8_substrings": op8_substrings,
    "op7_pieces": op7_pieces, "op9_html": op9_html, "op10_media": op10_media, "op11_quality": op11_quality,
    "op12_divergence": op12_divergence, "op13_whitening": op13_whitening,
}
ORACLE: dict[str, str] = {"op11_quality": oracles.QUALITY, "op12_divergence": oracles.DIVERGENCE}
