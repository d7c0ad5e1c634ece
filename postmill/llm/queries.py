"""The registered queries of the training-data operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import alignment, fim, html_text, jaccard, language, licenses, lm, media, mixing, packing, pii, quality, secrets
from postmill.llm.shared import ship, table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.fit(docs.where(lm.learning()))
    scored = lm.score(docs, model, carry=["doc_id"])
    return scored.select("doc_id", (~lm.learning()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~language.held_out("doc_id", 4)))
    found = language.identify(docs.select("doc_id", "text"), model, carry=["doc_id"])
    return found.select("doc_id", language.held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.withColumnsRenamed({"_rate": "rate", "_replica": "replica", "_order": "order_key"})


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = quality.fit(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return quality.judge(docs, ratios, carry=["doc_id"])


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    stored = media.store_texts(table(spark, sf_dir, "documents"))
    read = media.media_columns(stored, samples="payload", carry=["doc_id", "n_bytes", "media"])
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32)")).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "dhash", F.substring("thumb_sha256", 1, 16)).alias("feature"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[(s["kind"], s["start"], s["end"]) for s in spans] for spans in b["secrets"].to_pylist()]
            base = [[s for s in r if s[0] != "random"] for r in rows]
            counts = [pa.array([sum(k == kind for k, *_ in r) for r in base], pa.int64()) for kind in secrets.KINDS[:3]]
            hashed = [hashlib.sha256(secrets.digest(r).encode()).hexdigest() for r in base]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *counts, pa.array(hashed, pa.string()), pa.array([secrets.digest(r) for r in rows], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return html_text.extract_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("bigint"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, tagger=pii.learn(docs), carry=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    counts = [of(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    made = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    aligned = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return aligned.select("doc_id", *alignment.SUMS, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


QUERIES = {"op1_lm_score": op1_lm_score, "op2_language_id": op2_language_id, "op3_ngram_jaccard": op3_ngram_jaccard, "op5_quality": op5_quality, "op4_mix_sources": op4_mix_sources, "op10_html_text": op10_html_text, "op7_licenses": op7_licenses, "op6_media": op6_media, "op8_pack": op8_pack, "op9_secrets": op9_secrets, "op11_personal_data": op11_personal_data, "op12_fill_in_middle": op12_fill_in_middle, "op13_tokenizer_alignment": op13_tokenizer_alignment}
ORACLE_SQL: dict[str, str] = {"op4_mix_sources": mixing.MIX_SQL.format(docs="documents"), "op12_fill_in_middle": fim.FIM_SQL}
