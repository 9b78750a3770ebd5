"""Mixing sources to target weights: Sainte-Laguë seats for equal-token blocks, then documents in seeded order.

Only DataFrame expressions. Documents shrink to (id, source, words, hash) once; texts are read in no other step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwise.llm.common import same, with_order, written

#: Words of a block, hence of a seat. Fixed, so that quotas are as fine for a corpus of any size; seats grow with the data.
BLOCK = 1
WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target).

    Weights go round the sources in code point order, null last. Targets share the sum of all sizes by weight;
    none exceeds ``most`` times its source, and what is cut off is shared anew by weight. In ascending order of
    limit per weight, the sources up to some point stand at their limit and the level of the others follows;
    taking too few or too many as limited gives a lower level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("_limit", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    t = (t.withColumn("_level", (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("_limit").over(before), F.lit(0)))
                      / F.sum("weight").over(rest))
         .withColumn("_level", F.max(F.when(F.col("_level") * F.col("weight") <= F.col("_limit"), F.col("_level"))).over(everywhere)))
    return t.select("source", "source_size", "weight",
                    F.least(F.col("_level") * F.col("weight"), F.col("_limit").cast("double")).alias("target"))


def sainte_lague(targets: DataFrame, seats: int) -> DataFrame:
    """(source, target) to (source, quota): ``seats`` seats go to the highest quotients target / (2k + 1); ties to the earlier source.

    Rounding the targets over a common divisor gives the seats of all quotients above a level. The divisor for which the
    targets make half a source each fewer than ``seats`` gives no seat too many, the one for half a source each more gives
    enough; about two quotients a source lie between them, and only those are ordered, however many seats there are.
    """
    everywhere = Window.partitionBy()
    t = (targets.where("target > 0").withColumn("_share", F.col("target") / F.sum("target").over(everywhere))
         .withColumn("_slack", F.count(F.lit(1)).over(everywhere) / 2 + 1))

    def rounded(total: Column) -> Column:
        return F.floor(F.col("_share") * F.greatest(total, F.lit(0)) + 0.5).cast("long")

    t = t.select("source", "target", rounded(F.lit(seats) - F.col("_slack")).alias("_sure"),
                 rounded(F.lit(seats) + F.col("_slack")).alias("_most"))
    t = t.withColumn("_left", F.lit(seats) - F.sum("_sure").over(everywhere))
    border = (t.where("_most > _sure").withColumn("_k", F.explode(F.sequence("_sure", F.col("_most") - 1)))
              .select("source", "_left", (F.col("target") / (2 * F.col("_k") + 1)).alias("_q")))
    by_quotient = Window.orderBy(F.col("_q").desc(), F.col("source").asc_nulls_last())
    won = border.withColumn("_place", F.row_number().over(by_quotient)).where("_place <= _left").select("source", F.lit(1).cast("long").alias("_n"))
    all_won = t.select("source", F.col("_sure").alias("_n")).union(won)
    return all_won.groupBy("source").agg(F.sum("_n").alias("quota")).where("quota > 0")


def rounds_and_rest(quotas: DataFrame, block: int, most: int) -> DataFrame:
    """Adds to (source, source_size, quota): ``_rounds``, the times that the whole source is taken, and ``_rest``, the
    words that the last, partial round takes from documents in seeded order.

    A quota of q blocks is q * block words, ``most`` times the source at most. A source whose target is too small for a
    seat takes its target.
    """
    words = F.when(F.col("quota") > 0, F.col("quota") * F.lit(block)).otherwise(F.ceil("target"))
    goal = F.least(words, F.col("source_size") * F.lit(most))
    return (quotas.withColumn("_goal", goal)
            .withColumn("_rounds", F.expr("if(source_size > 0, _goal div source_size, 0)"))
            .withColumn("_rest", F.col("_goal") - F.col("_rounds") * F.col("source_size")).drop("_goal"))


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 17,
        seats: int | None = None) -> DataFrame:
    """Words to take from every document so that sources meet their target weights.

    Input columns used: doc_id, text, source. Output, a row per input row: doc_id, source, size, source_size,
    target, quota (blocks of BLOCK words, or ``seats`` blocks), taken. ``taken`` counts repeats and never exceeds ``most``
    times ``size``; the last round takes whole documents in seeded order until the quota is met, so that one document
    of a source at most is taken in part. Null texts have size 0 and take 0; null
    is a source of its own, last in order; an empty table gives an empty result; equal rows take what their places
    in the seeded stream give, the same in every run.
    """
    slim = documents.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit(""))).alias("_h"))
    slim = written(slim, "mix-sizes")
    head = slim.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    block = max(1, head["words"] // seats) if seats else BLOCK
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights, most), "mix-targets")
    quotas = sainte_lague(targets, round(head["words"] / block))
    per_source = targets.alias("t").join(quotas.alias("q"), same("t", "q", ["source"]), "left").select(
        "t.source", "source_size", "target", F.coalesce("quota", F.lit(0)).cast("long").alias("quota"))
    per_source = written(rounds_and_rest(per_source, block, most), "mix-quotas")
    placed = with_order(slim, ["source"], "_h", ["doc_id", "size"], "size", rows=head["n"])
    s = F.broadcast(per_source.withColumnRenamed("source", "_s"))
    out = placed.join(s, F.col("source").eqNullSafe(F.col("_s")))
    partial = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before")))
    taken = F.col("_rounds") * F.col("size") + partial
    return out.select("doc_id", "source", "size", "source_size", "target", "quota", taken.cast("long").alias("taken"), "_h")


def apply_mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 17,
              seats: int | None = None) -> DataFrame:
    """The mixed rows themselves: whole copies of a document as often as taken, then its first words for the rest.

    Documents of which nothing is taken go. Columns are those of the input; a given n_chars follows the text.
    Equal rows count as one row that is taken as often as they together.
    """
    taken = mix(documents, weights, most, seed, seats).groupBy("doc_id", "_h").agg(
        F.sum("taken").alias("_taken"), F.first("size").alias("_size")).where("_taken > 0")
    rows = documents.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit(""))))
    hit = rows.alias("d").join(taken.alias("t"), same("d", "t", ["doc_id", "_h"])).select("d.*", "_taken", "_size")
    hit = hit.dropDuplicates(["doc_id", "_h"])
    copies = F.expr("transform(sequence(1, (_taken + _size - 1) div _size), i -> least(_size, _taken - (i - 1) * _size))")
    each = hit.withColumn("_words", F.explode(copies))
    first_words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"([\x20\x09-\x0D]*{WORDS})"), 1), F.lit(1), F.col("_words").cast("int")), "")
    each = each.withColumn("text", F.when(F.col("_words") < F.col("_size"), first_words).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        each = each.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return each.select(*documents.columns)
