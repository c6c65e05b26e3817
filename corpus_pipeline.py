"""A corpus pipeline: quality, language, near duplicates, mixture, tokens. Part of the training-data operators.

Each stage takes (spark, docs, folder) and works on all rows its predecessor kept. The first four return the columns of
``documents``; the last returns them without the text and with the tokens.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm import bpe, language, mixing, near_text, quality_text
from tollgate.llm.queries import id_fold, labelled_docs, table, tokenizer_path
from tollgate.sources.artifacts import materialize, settle  # noqa: F401 (a stage by itself is written with materialize)

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if its quality score reaches this.
QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 9, learned from the labelled part of the documents; texts that score below ``QUALITY`` go.

    Null and empty texts are scored like any other. Repeated rows are scored alike. An empty table stays empty.
    """
    model = quality_text.fit(labelled_docs(spark, folder, docs))
    return quality_text.score(docs, model, keep=tuple(COLUMNS)).where(F.col("quality") >= QUALITY).select(*COLUMNS)


def keep_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 8, learned from two thirds of the documents; texts of no language (null or without a letter) go, and
    ``lang`` is the language found. An empty table, or one in which no language is known, leaves nothing."""
    model = language.fit(docs.where(id_fold(3) != 1))
    found = language.identify(docs, model, keep=tuple(COLUMNS))
    return found.where(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 6; of each group of rows with near texts the one with the smallest id stays (of equal ids any one, a null id
    last). Rows are compared, not ids: texts that share an id live and go by themselves. A row that
    repeats with its id and text stays once. Texts without words have no copies.

    Rows are told apart by 64 bits of a hash of id and text: in a billion of them two share it with odds of 1 to 37, and are then one row.
    """
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    drop = settle(spark, lambda: _dropped(rows), "dropped")
    sent = lambda marked: F.broadcast(marked) if drop.count() <= near_text.IDS_SENT else marked
    again = drop.where("again").select("__row")
    out = rows.join(sent(drop.select("__row")), "__row", "left_anti").select(*COLUMNS)
    if not again.isEmpty():
        kept = rows.join(sent(again), "__row", "left_semi").groupBy("__row").agg(F.min(F.struct(*COLUMNS)).alias("row"))
        out = out.unionByName(kept.select("row.*"))
    return out


def _dropped(rows: DataFrame) -> DataFrame:
    """``__row, again``: rows that go, and those that repeat, of which one stays."""
    found = near_text.near_duplicates(rows, "__row", "text")
    linked = found.where("not kept").select("component_id").distinct()
    members = found.join(linked, "component_id").select(F.col("id").alias("__row"), "component_id").distinct()
    ids = rows.select("__row", "doc_id").join(members, "__row")
    stays = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"].alias("__row"))
    gone = members.join(stays, "__row", "left_anti").select("__row", F.lit(False).alias("again"))
    repeated = found.groupBy(F.col("id").alias("__row")).count().where("count > 1").select("__row")
    return gone.unionByName(repeated.join(gone, "__row", "left_anti").select("__row", F.lit(True).alias("again")))


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 2; documents appear as often as the mix takes them, the one at a source's cut with the words taken.

    A null source is a source like any other; null and empty texts have no words and are taken no times. An empty table stays empty.
    """
    return mixing.copies(mixing.mix_sources(docs.select(*COLUMNS), mixing.word_count(F.col("text")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Operator 5; each document's tokens, their number, and the digest of the text they decode to.

    Null and empty texts have no tokens and decode to the empty text. An empty table stays empty.
    """
    path = tokenizer_path()
    encoded = bpe.encode(docs, path, bpe.build_lexicon(docs, path), keep=("doc_id", "lang", "source", "n_chars"), decoded=True)
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_duplicates", drop_near_duplicates),
          ("mixture", mix), ("tokens", tokenize)]

#: SQL can express neither the learned stages nor the merges; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next. A stage's own cut points go with its end."""
    docs = table(spark, folder, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = settle(spark, partial(stage, spark, docs, folder), name)
    return docs
