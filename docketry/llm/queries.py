"""The driver's queries over these operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import infill, interpolation, licenses, pieces, ppm, repeats, resample, sharding, simhash, tiff, toxicity, warc, winnow

#: Shards that op8_shard_table places documents on.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    media = tiff.write_tiff(docs).select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media"
    )
    keep = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    return tiff.page_digests(tiff.read_tiff(media, keep), keep)


def op2_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.kept_digests(table(spark, sf_dir, "documents"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = remainder("doc_id", 10)
    scores = interpolation.score(table(spark, sf_dir, "documents"), training=fold != 0, tuning=fold == 1)
    return scores.select("doc_id", (fold == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer(), digests=True)


def categories() -> dict[str, Column]:
    """The chain's categories, by what labels say, in turn."""
    return {"degraded": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def op6_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.learn(docs, table(spark, sf_dir, "labels"), categories())
    return toxicity.score(docs, chain, ["doc_id"])


def remainder(key: str, by: int):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = ppm.learn(docs, "doc_id", "text", "lang", remainder("doc_id", 4) != 2, per_language=300)
    return ppm.predict(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op9_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_rope_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.infill(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return infill.restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.folder(spark)
    warc.archive(table(spark, sf_dir, "pages"), path)
    back = warc.read(spark, path, ["record_type", "record_id", "refers_to", "payload_sha1", "http_headers", "payload"]).where(F.col("record_type").isin("response", "revisit"))
    revisit = F.col("record_type") == "revisit"

    def page(record_id: str):
        return F.substring(record_id, len("urn:page:") + 1, 20).try_cast("long")

    return back.select(
        page("record_id").alias("page_id"), F.when(revisit, F.col("http_headers")["content-length"].cast("long")).otherwise(F.octet_length("payload")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_sha1")).otherwise(F.sha1("payload")).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"),
    )


def _op8_sql() -> str:
    shards = ", ".join(str(k) for k in sharding.lookup_table(SHARDS))
    return f"""
    WITH placed AS (SELECT doc_id, (('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % {sharding.TABLE_SIZE})::INTEGER AS slot FROM documents),
         owners AS (SELECT [{shards}] AS owner)
    SELECT doc_id, slot, 'shard-' || lpad(CAST(owner[slot + 1] AS VARCHAR), 3, '0') AS shard FROM placed, owners"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_tiff_pages, op2_phrase_automata, op3_winnowing, op4_deleted_interpolation, op5_sentencepiece, op6_classifier_chain, op7_ppm, op8_shard_table, op9_simhash_gray, op10_license_scan, op11_rope_infill, op12_crc_resampling, op13_warc_source)}


def oracle_sql() -> dict[str, str]:
    return {"op8_shard_table": _op8_sql(), "op10_license_scan": licenses.sql(), "op11_rope_infill": infill.sql(), "op12_crc_resampling": resample.sql(), "op13_warc_source": warc.sql()}
