"""Benchmark decontamination: a distributed positional inverted index, in DataFrame operations alone.

One pass over the texts stores postings (document, place, term) of the terms that
the benchmark uses, and each document's length. Each benchmark window is then looked
for from its rarest term on: the list of that term, less the term's offset, gives
possible starts; the second-rarest term's list, less its own offset, is intersected
with them; the starts that are left are intersected with the lists of all other terms.

The benchmark's terms, window terms and so on are broadcast only while their counted
rows stay within BROADCAST_ROWS; beyond that Spark joins them by shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Between words: ASCII that is no digit or letter (A-Z are lowered after the cut).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands after a document's last word, so its place is the number of words. No word holds it.
END = "\x00"
#: Rows of a benchmark table (a term of some tens of bytes and three numbers) that may be broadcast: about 64 MB.
BROADCAST_ROWS = 500_000


def end_id() -> Column:
    return F.xxhash64(F.lit(END))


def raw_words(text: Column) -> Column:
    """Words of the text as they stand; null: none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS), "")


def low(word: Column) -> Column:
    """The word with A-Z (alone) lower-cased."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.transform(raw_words(text), low)


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its rows, counted, are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def window_terms(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(item, w1, w2, size, k, term): the k-th word of each distinct window; w1 and w2 name it by 128 bits."""
    item = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = item.select("item", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1)))).alias("at"))
    window = starts.select("item", F.slice("words", F.col("at"), F.lit(n)).alias("window")).distinct()
    named = window.select("item", F.xxhash64("window").alias("w1"), F.xxhash64(F.lit(1), "window").alias("w2"), F.size("window").alias("size"), "window")
    return named.select("item", "w1", "w2", "size", F.posexplode("window").alias("k", "term"))


def postings(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The stored index: (doc, dig, at, tid) of every place of a term, and for each row of docs its END."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    placed = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("dig"), F.posexplode(F.concat(raw_words(text), F.array(F.lit(END)))).alias("at", "word"))
    ends = terms.sparkSession.createDataFrame([(END,)], "term string")
    tids = terms.unionByName(ends).select(F.xxhash64("term").alias("tid")).distinct()
    # words are lowered and named after they are apart, in generated code, and looked up by number
    return common.written(placed.select("doc", "dig", "at", F.xxhash64(low(F.col("word"))).alias("tid")).join(small(tids), "tid").select("doc", "dig", "at", "tid"), "postings")


ROW = ["doc", "dig"]


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc, dig, start, size, w1, w2) of every exact occurrence of a window. windows: (w1, w2, size, k, tid)."""
    index = index.withColumn("doc", F.coalesce("doc", F.lit(-(1 << 63))))  # joins below need equal ids
    counts = index.where(F.col("tid") != end_id()).groupBy("tid").count()
    counted = windows.join(counts, "tid", "left")
    by = Window.partitionBy("w1", "w2")
    ranked = counted.withColumn("rank", F.row_number().over(by.orderBy("count", "tid", "k"))).withColumn("known", F.count("count").over(by)).where("known = size")  # a term without a place rules its window out
    ranked = common.written(ranked.select("w1", "w2", "size", "k", "tid", "rank"), "window-terms")
    rarest = small(ranked.where("rank = 1"))
    starts = index.join(rarest, "tid").where("at >= k").select(*ROW, (F.col("at") - F.col("k")).alias("start"), "w1", "w2", "size").distinct()
    second = small(ranked.where("rank = 2").select("w1", "w2", F.col("k").alias("k2"), F.col("tid").alias("tid2")))
    lists = index.join(small(ranked.where("rank = 2").select("tid").distinct()), "tid", "left_semi")
    probe = starts.join(second, ["w1", "w2"], "left").select("*", (F.col("start") + F.col("k2")).alias("at"), F.col("tid2").alias("tid"))
    one_word = probe.where("tid is null").select(*ROW, "start", "size", "w1", "w2")
    two = probe.where("tid is not null").join(lists, [*ROW, "at", "tid"], "left_semi").select(*ROW, "start", "size", "w1", "w2")
    two = common.written(two.union(one_word), "starts")
    rest = small(ranked.where("rank > 2").select("w1", "w2", "k", "tid"))
    wanted = two.where("size > 2").join(rest, ["w1", "w2"]).select(*ROW, (F.col("start") + F.col("k")).alias("at"), "tid", "start", "size", "w1", "w2")
    there = index.join(small(ranked.where("rank > 2").select("tid").distinct()), "tid", "left_semi")
    full = wanted.join(there, [*ROW, "at", "tid"], "left_semi").groupBy(*ROW, "start", "size", "w1", "w2").count().where("count = size - 2").drop("count")
    return full.unionByName(two.where("size <= 2"))


def proximity_matches(index: DataFrame, windows: DataFrame, within: int) -> DataFrame:
    """(doc, dig, w1, w2, at): places of a window's rarest term with all its other terms, in any order, at most `within` words away."""
    index = index.withColumn("doc", F.coalesce("doc", F.lit(-(1 << 63))))
    counts = index.where(F.col("tid") != end_id()).groupBy("tid").count()
    terms = windows.select("w1", "w2", "tid").distinct()
    by = Window.partitionBy("w1", "w2")
    ranked = terms.join(counts, "tid", "left").withColumn("rank", F.row_number().over(by.orderBy("count", "tid"))).withColumn("n", F.count("*").over(by)).withColumn("known", F.count("count").over(by)).where("known = n")
    ranked = common.written(ranked.select("w1", "w2", "tid", "rank", "n"), "window-terms")
    span = within + 1
    centre = index.join(small(ranked.where("rank = 1")), "tid").select(*ROW, F.col("at").alias("c"), "w1", "w2", "n").distinct()
    others = centre.join(small(ranked.where("rank > 1").select("w1", "w2", "tid")), ["w1", "w2"])
    cell = others.select("*", F.explode(F.array(*(F.floor(F.col("c") / span).cast("int") + d for d in (-1, 0, 1)))).alias("cell"))
    found = cell.join(index.withColumn("cell", F.floor(F.col("at") / span).cast("int")), [*ROW, "tid", "cell"]).where(F.abs(F.col("at") - F.col("c")) <= within)
    near = found.groupBy(*ROW, "w1", "w2", "c", "n").agg(F.count_distinct("tid").alias("m")).where("m = n - 1")
    return near.unionByName(centre.where("n = 1").withColumn("m", F.lit(0).cast("long"))).select(*ROW, "w1", "w2", F.col("c").alias("at"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items (sorted strings) and contaminated.

    A window is n consecutive words of an item (all of a shorter one). A null text
    has no words; items without words or id have no windows; null ids of docs are
    ids like others; repeated rows get equal results; other columns are left behind; an
    empty table, of docs or of items, gives no rows, or none that is contaminated. Texts
    of any length are cut into words whole, in one row's array.
    """
    terms = common.written(window_terms(benchmark, n, item_id, item_text), "benchmark-terms")
    windows = terms.select("w1", "w2", "size", "k", F.xxhash64("term").alias("tid")).distinct()
    index = postings(docs, terms.select("term").distinct(), id_col, text_col)
    hits = common.written(phrase_matches(index, windows), "phrase-matches")
    spans = hits.select(*ROW, "start", (F.col("start") + F.col("size")).alias("end")).groupBy(*ROW, "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy(*ROW).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))  # of one document
    n_hit = spans.select(*ROW, F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0)))).alias("m")).groupBy(*ROW).agg(F.sum("m").cast("long").alias("n_hit"))
    owners = small(terms.select("w1", "w2", "item").distinct())
    items = hits.select(*ROW, "w1", "w2").distinct().join(owners, ["w1", "w2"]).select(*ROW, F.col("item").cast("string").alias("item")).distinct().groupBy(*ROW).agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = n_hit.join(items, ROW).withColumnRenamed("doc", "key")
    rows = index.where(F.col("tid") == end_id()).select("doc", F.coalesce("doc", F.lit(-(1 << 63))).alias("key"), "dig", F.col("at").cast("long").alias("n_words"))
    out = rows.join(found, ["key", "dig"], "left")
    return out.select(
        F.col("doc").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns whatever their names, that hold no window of the benchmark.

    Rows are told apart by id and text, so repeated rows go or stay together. Null and
    empty texts, and those of signs alone, hold none and stay; an empty table stays so.
    """
    terms = common.written(window_terms(benchmark, n, "item_id", "text"), "benchmark-terms")
    windows = terms.select("w1", "w2", "size", "k", F.xxhash64("term").alias("tid")).distinct()
    hits = phrase_matches(postings(docs, terms.select("term").distinct(), id_col, text_col), windows)
    bad = small(common.written(hits.select("doc", "dig").distinct(), "contaminated")).alias("b")
    a = common.carried(docs, id_col, text_col).alias("a")
    return a.join(bad, (F.coalesce(F.col("a.doc"), F.lit(-(1 << 63))) == F.col("b.doc")) & (F.col("a.dig") == F.col("b.dig")), "left_anti").select("row.*")


def op5_positional_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
