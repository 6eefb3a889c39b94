"""From raw documents to training sequences: the stages, and :func:`run` that applies them.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``docs``, others than those of documents too, whatever their names.

Defined cases: a null text counts as empty: it isn't toxic, goes for its language
(it has no letter), and would be linked with nothing and packed as its end alone.  A null
``doc_id`` is a document like others.  Repeated rows are copies: one of them stays.  Rows that share an id
but not their text are judged each for itself.  Texts count whole, whatever their length.  Equal scores
are judged alike.  An empty table gives an empty table; without labels nothing is
toxic, and without a learned language every document stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import jaccard, language, packing, secrets, toxicity
from tidewell.llm.common import Workspace, crc_mod, fresh
from tidewell.llm.queries import TOXIC_FROM, tokenizer_file

#: Documents whose language has a lower posterior are rejected, as are those without a letter.
LANGUAGE_FROM = 0.5
#: Keys of rejected copies that are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(crc_mod("doc_id", 3) != 1)
    (score,) = fresh(docs, "_score")
    return toxicity.score(docs, toxicity.fit(docs, labels), into=score).filter(F.col(score) < TOXIC_FROM).drop(score)


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of which no learned language is likelier than the others together."""
    model = language.fit(docs, tokenizer_file("piece_bpe_32k.model"), Workspace(spark, "language"), learn=crc_mod("doc_id", 5) != 0)
    if not model.languages:
        return docs
    names = fresh(docs, "_lang_pred", "_score")
    judged = language.predict(docs, model, into=tuple(names))
    return judged.filter((F.col(names[0]) != "und") & (F.col(names[1]) >= LANGUAGE_FROM)).select(*[f"`{c}`" for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links join, the one with the least id stays; null ids come last, equal ids go by the row's number."""
    work, (row, other) = Workspace(spark, "near-copies"), fresh(docs, "_row", "_gone")
    rows = work.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    linked = jaccard.link(rows.select(row, "text"), work, key=row).select(F.col(row).alias("r"), F.col("component_id").alias("g"))
    ids = rows.select(F.col(row).alias("k"), F.col("doc_id").alias("id"))
    ranked = linked.join(ids, F.col("r") == F.col("k")).select("r", "g", F.struct(F.col("id").isNull().alias("none"), "id", "r").alias("rank"))
    kept = ranked.groupBy("g").agg(F.min("rank").alias("rank")).select(F.col("rank.r").alias("r"))
    gone = work.write(linked.select("r").join(kept, "r", "left_anti").withColumnRenamed("r", other), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return rows.join(gone, F.col(row) == F.col(other), "left_anti").select(*[f"`{c}`" for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their ids."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("language", reject_unknown_language),
    ("near_copies", one_of_each_group),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), name)
        if i:
            work.drop(STAGES[i - 1][0])
    return docs
