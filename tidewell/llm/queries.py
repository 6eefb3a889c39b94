"""The registered queries of this subpackage: thin wrappers that run an operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bottomk, bpe, hmm, jaccard, language, media, merkle, packing, phrases, ranked, secrets, token_files, toxicity
from tidewell.llm.common import Workspace, crc_mod, documents
from tidewell.llm.sql import ORACLE_SQL  # noqa: F401


#: Documents with at least this score are predicted to be toxic.
TOXIC_FROM = 0.7


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hmm.score(documents(spark, sf_dir, "doc_id", "text"), Workspace(spark, "hmm"), crc_mod("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir, "doc_id", "text", "lang"), crc_mod("doc_id", 5) == 0
    model = language.fit(docs, tokenizer_file("piece_bpe_32k.model"), Workspace(spark, "language"), learn=~held_out)
    return language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode_texts(documents(spark, sf_dir, "doc_id", "text"), path, pattern)
    back = bpe.decode_ids(ids.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids"), path, pattern)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_media(documents(spark, sf_dir, "doc_id", "text"), "text", "media", "doc_id")
    stored = stored.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    found = media.probe_media(stored, "media", "doc_id", "n_bytes", "media_bytes", "media_sha256", payload=True)
    size = F.length("payload").cast("long")
    return found.select("doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), "media_bytes", "media_sha256", media.feature().alias("feature"))


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = merkle.pair_with_next(merkle.add_fingerprint(docs), "doc_id", "text", "fingerprint")
    edited = merkle.add_fingerprint(pairs.withColumn("edited", merkle.replace_half(F.col("text"), F.col("next_text"))), "edited", "edited_fingerprint")
    own = F.col("fingerprint")
    return edited.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), merkle.compact(own).alias("fingerprint"), merkle.compact(F.col("edited_fingerprint")).alias("edited_fingerprint"), merkle.root(own).alias("root"), merkle.root(F.col("edited_fingerprint")).alias("edited_root"), merkle.likeness(own, F.col("edited_fingerprint")).alias("near_edited"), merkle.likeness(own, F.col("next_fingerprint")).alias("near_next"))


def op6_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(documents(spark, sf_dir, "doc_id", "text"), tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir, "doc_id", "text"))

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(documents(spark, sf_dir, "doc_id", "text"), Workspace(spark, "jaccard"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(crc_mod("doc_id", 3) != 1)
    scored = toxicity.score(docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text"), toxicity.fit(docs, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "token-files")
    blocks = token_files.write_documents(documents(spark, sf_dir, "doc_id", "text"), work, tokenizer_file("byte_bpe_50k.json"))
    return token_files.read_documents(blocks).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir, "lang", "text"), Workspace(spark, "phrases"))


def op12_bottomk_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.link(documents(spark, sf_dir, "doc_id", "text"), Workspace(spark, "bottomk"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "ranked")
    index, total = ranked.write_index(documents(spark, sf_dir, "doc_id", "text"), work)
    return ranked.search(index, total, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), work)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hmm_scores, op2_language_id, op3_bpe_roundtrip, op4_media_columns, op5_merkle_fingerprints, op6_cost_packing, op7_secret_scan, op8_jaccard_components, op9_toxicity, op10_token_files, op11_phrases, op12_bottomk_components, op13_ranked_search)}
