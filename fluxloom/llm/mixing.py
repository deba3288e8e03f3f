"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

DataFrame operations alone. A level (words for each unit of weight) is raised until the
sources that are clamped at their most epochs stay the same; each round is one aggregation
of the sources' table. Every document of a source is repeated target // size times; of the
remainder, the documents that come first in a seeded order get one repetition more, and
the one at which the remainder ends a part of it. That place is found by radix: sums of the
order's next hex digits in all sources at once, a round for each two digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WEIGHTS = (5, 2, 1)
#: Rows of the sources' table (a name and nine numbers) that may be broadcast; beyond it rows are dealt by source and SALTS.
BROADCAST_SOURCES, SALTS = 100_000, 64
#: The search goes on while a source has more rows than this at its open digits.
OPEN_ROWS = 200
SPACES = r"[\x20\x09-\x0D]+"
BETWEEN = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def size_of(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACES), "")).cast("long")


def sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, *kept: Column) -> DataFrame:
    """doc, dig, source, size and key: 32 hex digits, the first half of seed and id, the rest of the text; and what is kept of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*kept, F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("dig"), F.col(source_col).cast("string").alias("source"), size_of(text).alias("size"))
    drawn = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))), 256), 1, 16)
    return rows.withColumn("key", F.concat(drawn, F.lpad(F.lower(F.hex("dig")), 16, "0")))


def met(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with their source's columns. Few sources are broadcast; of many, a source's row goes out SALTS times, so that one with a third of all rows is dealt among as many tasks."""
    names = [c for c in sources.columns if c != "source"]
    b = sources.withColumnRenamed("source", "its_source")
    if sources.count() <= BROADCAST_SOURCES:
        out = rows.join(F.broadcast(b), common.same(F.col("source"), F.col("its_source")))
    else:
        b = b.withColumn("its_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        out = salted.join(b, common.same(F.col("source"), F.col("its_source")) & (F.col("salt") == F.col("its_salt")))
    return out.select(*rows.columns, *names)


def water_filled(sources: DataFrame, max_epochs: int) -> DataFrame:
    """sources (weight, source_size) with target: shares of all words by weight, none above max_epochs times its size."""
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    clamped, level = -1, 0.0
    while True:
        # the level only rises, so a clamped source stays so and the rounds end
        full = cap < F.lit(level) * F.col("weight")
        r = sources.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("caps"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open")).first()
        if r.n == clamped or not r.open:
            break
        clamped, level = r.n, float(total - r.caps) / float(r.open)
    target = F.when(full, cap.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return sources.withColumn("target", target)


def remainders(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with edge and part: rows of smaller keys than edge get one repetition more, those of this key `part` words, later ones nothing."""
    state = sources.select("source", F.lit("").alias("open"), F.lit(0).cast("long").alias("before"), "rest").where("rest > 0")
    for digits in range(2, 34, 2):
        here = met(rows, state).where(F.col("key").startswith(F.col("open"))).select("source", "before", "rest", F.substring("key", 1, digits).alias("cell"), "size")
        cells = here.groupBy("source", "before", "rest", "cell").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.col("before") + F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 256 cells of a source at most
        crossed = cells.withColumn("upto", upto).where((F.col("upto") < F.col("rest")) & (F.col("upto") + F.col("words") >= F.col("rest")))
        crossed = common.written(crossed.select("source", F.col("cell").alias("open"), F.col("upto").alias("before"), "rest", "n"), "mixing-state")
        state = crossed.drop("n")
        if (crossed.agg(F.max("n")).first()[0] or 0) <= OPEN_ROWS:
            break
    # rows of one key agree in id and text: they share what is left in equal parts
    last = met(rows, state).where(F.col("key").startswith(F.col("open"))).groupBy("source", "before", "rest", "key").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    upto = F.col("before") + F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = last.withColumn("upto", upto).where((F.col("upto") < F.col("rest")) & (F.col("upto") + F.col("words") >= F.col("rest")))
    edge = edge.select(F.col("source").alias("its_source"), F.col("key").alias("edge"), F.floor((F.col("rest") - F.col("upto")) / F.col("n")).cast("long").alias("part"))
    return sources.join(edge, common.same(F.col("source"), F.col("its_source")), "left").select(*sources.columns, "edge", "part")


def shares(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Per source: source_size, target, whole (repetitions of each document), edge and part. A written table."""
    if max_epochs < 1 or max_epochs != int(max_epochs) or not weights or min(weights) <= 0:
        raise ValueError("max_epochs is a whole number from 1 on, weights are positive")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = common.ranked(sums, [F.col("source").asc_nulls_last()], "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    filled = water_filled(common.written(placed.select("source", "source_size", weight.alias("weight")), "sources"), max_epochs)
    quota = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.coalesce(F.floor(quota / F.col("source_size")).cast("long"), F.lit(0).cast("long"))  # no words: null
    parts = filled.select("source", "source_size", "target", F.when(F.col("source_size") > 0, whole).otherwise(0).alias("whole"), quota.alias("quota"))
    parts = common.written(parts.withColumn("rest", F.when(F.col("source_size") > 0, F.col("quota") - F.col("whole") * F.col("source_size")).otherwise(0)), "source-shares")
    return common.written(remainders(rows, parts).select("source", "source_size", "target", "whole", "edge", "part"), "source-edges")


def more() -> Column:
    """Words of a row's repetition beyond the whole ones."""
    return F.when(F.col("key") < F.col("edge"), F.col("size")).when(F.col("key") == F.col("edge"), F.col("part")).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of docs: id, source, size (words), source_size, target (its source's) and taken (words, repetitions counted).

    Sources in code-point order, null last, get `weights` again and again, and shares of as
    many words as docs have, none of more than max_epochs times its size. A source's rows
    take its target, rounded, but for less than one word a copy where rows of one id and
    text are repeated: those share the last part equally. Null and empty texts have no
    words and take none; so does a source without words. Null ids are drawn for by their
    texts; other columns are left behind; an empty table gives no rows. A text of any length
    is counted whole, in one row's array.
    """
    rows = common.written(sized(docs, seed, id_col, text_col, source_col), "sizes")
    out = met(rows, shares(rows, weights, max_epochs))
    return out.select(F.col("doc").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("whole") * F.col("size") + more()).alias("taken"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of docs, all columns whatever their names, each as often as mix() takes it; the text of a row's last repetition is cut after the words taken.

    Rows as in mix(); those without words come once for each whole repetition.
    """
    its = shares(common.written(sized(docs, seed, id_col, text_col, source_col), "sizes"), weights, max_epochs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = met(sized(docs, seed, id_col, text_col, source_col, F.struct("*").alias("row"), text.alias("text")), its).withColumn("more", more())
    copies = out.select("row", "text", "size", "more", F.explode(F.concat(F.array_repeat(F.lit(False), F.col("whole").cast("int")), F.array_repeat(F.lit(True), (F.col("more") > 0).cast("int")))).alias("last"))
    words = F.split("text", BETWEEN)
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.array_join(F.slice(words, F.lit(1), (F.col("more") + lead).cast("int")), "")
    text = F.when(F.col("last") & (F.col("more") < F.col("size")), cut).otherwise(F.col("row").getField(text_col).cast("string"))
    return copies.select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*")


def op13_water_filled_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).drop("source")
