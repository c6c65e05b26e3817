"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm import (
    bpe, byte_bpe, interpolation, language, licences, mixing, near_text, near_vectors, neighbours_index, quality_text, sharding,
    whitening, word_runs)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_fold(folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds


@query
def op1_licences(spark, folder):
    return licences.scan_licences(table(spark, folder, "documents").select("doc_id", "text"))


ORACLES["op1_licences"] = licences.oracle_sql()


@query
def op2_mix_sources(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    mixed = mixing.mix_sources(docs, F.col("words"))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLES["op2_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT source, ss, 2 * ss AS lim, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(ss) OVER ())::DOUBLE - (sum(lim) OVER o - lim)::DOUBLE)
                / ((sum(w) OVER ()) - (sum(w) OVER o) + w)::DOUBLE AS lv FROM w
      WINDOW o AS (ORDER BY lim::DOUBLE / w::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, ss, least(lim::DOUBLE, (max(lv) OVER ()) * w) AS target FROM l),
r AS (SELECT *, CASE WHEN ss > 0 THEN floor(target)::BIGINT // ss ELSE 0 END AS rounds FROM t),
q AS (SELECT *, floor(target)::BIGINT - rounds * ss AS rest FROM r),
g AS (SELECT source, k, size, count(*) AS n FROM d GROUP BY ALL),
c AS (SELECT *, (sum(n * size) OVER (PARTITION BY source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - n * size)::BIGINT AS start FROM g)
SELECT d.doc_id, d.size, q.ss AS source_size, q.target,
       (q.rounds * d.size + greatest(0, least(d.size, (q.rest - c.start) // c.n)))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.k = d.k AND c.size = d.size"""


@query
def op6_near_documents(spark, folder):
    found = near_text.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


ORACLES["op6_near_documents"] = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a AS node, b AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT node, least(node, min(seen)) AS component_id FROM r GROUP BY node)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, t.doc_id) AS component_id,
       coalesce(m.component_id, t.doc_id) = t.doc_id AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN m ON m.node = t.doc_id"""


@query
def op7_shards(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), sharding.shard_key(F.col("text"), F.col("doc_id")).alias("key"))
    rows = sharding.shard_rows(docs, F.col("key"), F.col("size"), shards=24)
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "size", F.col("row.text_crc32").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op5_bpe(spark, folder):
    docs, path = table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path()
    decoded = bpe.encode(docs, path, bpe.build_lexicon(docs, path), decoded=True)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_language(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", (id_fold(3) == 1).alias("held_out"))
    model = language.fit(docs.where("not held_out"))
    return language.identify(docs, model, keep=("doc_id", "held_out"))


def labelled_docs(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """Documents with a quality label, of the rows that may be learned from; as many labels as are fitted at most."""
    labels = table(spark, folder, "labels").where((id_fold(5) != 0) & F.col("quality").isin(0, 1))
    sample = quality_text.sample_labels(labels.select("doc_id", F.col("quality").alias("label")))
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


@query
def op9_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", (id_fold(5) == 0).alias("held_out"))
    scored = quality_text.score(docs, quality_text.fit(labelled_docs(spark, folder, docs)), keep=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))


@query
def op4_interpolation(spark, folder):
    docs, fold = table(spark, folder, "documents").select("doc_id", "text"), id_fold(5)
    # Of the four training parts one is deleted while the weights are learned.
    role = F.when(fold == 1, interpolation.SCORED).when(fold == 0, interpolation.DELETED).otherwise(interpolation.RETAINED)
    scored = interpolation.interpolated_scores(docs, role)
    return scored.select("doc_id", (F.col("role") == interpolation.SCORED).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


@query
def op3_multi_index(spark, folder):
    return neighbours_index.nearest(table(spark, folder, "embeddings").select("vec_id", "embedding"), lambda i: i % 50 == 0)


@query
def op10_near_vectors(spark, folder):
    found = near_vectors.near_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return found.withColumnRenamed("id", "vec_id")


ORACLES["op10_near_vectors"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
      AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
n AS (SELECT *, sqrt(list_inner_product(x, x)) AS size FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id
      WHERE list_inner_product(a.x, b.x) >= 0.95 * (a.size * b.size)),
r AS (SELECT a AS node, b AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT node, least(node, min(seen)) AS component_id FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT t.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(m.component_id, t.vec_id) AS component_id,
       coalesce(m.component_id, t.vec_id) = t.vec_id AS kept
FROM embeddings t LEFT JOIN k ON k.a = t.vec_id LEFT JOIN m ON m.node = t.vec_id"""


@query
def op11_whitening(spark, folder):
    white = whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return white.withColumnRenamed("id", "vec_id")


def made_periodic(text: Column, doc_id: Column) -> Column:
    """The text, or for a tenth of the ids the text with its end replaced by repetitions of the words where that begins."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        return F.when(n > 0, F.array_join(F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " "))

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(h % 10 == 0, F.transform(F.array(words), repeat)[0]).otherwise(text)


@query
def op12_word_runs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", made_periodic(F.col("text"), F.col("doc_id")).alias("text"))
    found = word_runs.collapse_runs(docs)
    # Runs come by start and period, so the first of those with the greatest exponent is the one wanted.
    best = F.reduce("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumns({"best": best, "lines": F.array_join(lines, "")})
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_byte_bpe(spark, folder):
    encoded = byte_bpe.encode(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), decoded=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
