"""The registered queries over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.llm import (
    alignment, ann, chat, mixing, near_dup, pieces, pii, quality, reshard, simhash, suffix_dedup, target_sample, topk,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_nn_descent")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op2_min_cost_reshard")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Old shards follow the source, so they are as uneven as the sources; the 40 new ones hold equal rows."""
    docs = table(spark, sf, "documents")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(32))
    dealt = reshard.reshard(docs, old, lambda n: reshard.even_capacities(n, 40))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


@query("op3_order_minhash")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf, "documents")).select("doc_id", "class_id", "class_size", "kept")


@query("op4_neighbour_quality")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = spark.sparkContext.broadcast(quality.fit(docs, table(spark, sf, "labels")))
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


@query("op5_char_tagger_pii")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    weights = spark.sparkContext.broadcast(pii.fit(docs))
    return pii.digest(pii.find(docs, weights))


@query("op6_sainte_lague_mix")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf, "documents")))


#: A conversation whose texts hold control strings.
CONTROL_CONVERSATION = -7
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query("op8_chat_windows")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(CONTROL_CONVERSATION, i, role, CONTROL_TEXT) for i, role in enumerate(("user", "assistant"))],
                                "conv_id long, turn long, role string, text string")
    return chat.digests(chat.budgeted_windows(rows.unionByName(own)))


#: Vocabulary file of a public tokenizer.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op9_n_best_pieces")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text encoded, with the scores of its four best paths, and decoded again from its ids."""
    vocabulary = pieces.share_vocabulary(spark, PIECE_MODEL)
    back = pieces.encode(table(spark, sf, "documents").select("doc_id", "text"), vocabulary, decoded="decoded")
    return pieces.piece_digest(back.withColumn("same", F.col("decoded").eqNullSafe(F.col("text"))), "same")


@query("op10_exact_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_simhash_variants")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


_CRC = """list_reduce(list_prepend(4294967295, list_transform(range(strlen(w)), lambda i: CAST(
    (instr('0123456789ABCDEF', substr(x, CAST(2 * i + 1 AS INT), 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, CAST(2 * i + 2 AS INT), 1)) - 1 AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[CAST(xor(c & 255, b) + 1 AS INT)]))"""


@query("op12_target_resample", f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
v AS (SELECT w, xor(4294967295, {_CRC}) % 10000 AS bucket FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM d UNION SELECT w FROM b)), crc),
s AS (SELECT bucket, count(*) AS s FROM d JOIN v USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (w) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
f AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM d JOIN v USING (w) JOIN g USING (bucket) GROUP BY 1),
h AS (SELECT doc_id, CAST(list_reduce(list_transform(range(8), lambda i: CAST(instr('0123456789abcdef',
    substr(sha256('2024:' || doc_id), CAST(i + 1 AS INT), 1)) - 1 AS BIGINT)), lambda a, y: a * 16 + y) AS DOUBLE) AS h FROM documents),
r AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h LEFT JOIN f USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, rank FROM r
LEFT JOIN (SELECT * FROM o WHERE rank <= (SELECT 10 * count(*) // 100 FROM o)) USING (doc_id)""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return target_sample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


#: The other tokenizer file of the alignment.
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"


@query("op13_lockstep_alignment")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align_corpus(table(spark, sf, "documents"), BYTE_MODEL, PIECE_MODEL)
