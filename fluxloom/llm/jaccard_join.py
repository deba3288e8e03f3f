"""N-gram Jaccard join: a blocked sparse product of the documents' n-gram incidence.

Documents with equal sets are one row of the matrix (a node). Columns (n-grams) are
ordered by frequency class, rare first, then by hash; frequencies are those of a merged
count sketch, and any order gives the same result. A pair that reaches the threshold
shares a column among the first n - ceil(t n) + 1 of each row (n: the row's size), so
only those entries, the prefix blocks, are multiplied. Overlap counts are accumulated
over them, and pairs are discarded whose sizes, places or counts lie below these bounds:
 - the smaller size is at least t times the larger one;
 - where their first common column stands, each row must still hold as many columns
   as the pair needs in common (`needed`);
 - the common columns of the prefixes, and all after the longer prefix, are as many.
What is left is multiplied in full.

Only links that join components matter, so the product is taken in blocks:
 1. In a column, all nodes meet its hub alone, the node with the fewest columns of its
    own (that no other prefix holds): in a group of near copies that is what they
    are copies of. Each node is multiplied with the hubs that it shares most columns
    with; links contract the group. This is done ROUNDS times, each with other hubs.
 2. Columns that still hold nodes of different components give every pair across
    components, at its first common column and few others. No pair within a component
    is made, and none is left out across.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import components
from .sketch import CountMin, build

FREQUENCY = CountMin(log2_width=20, depth=1, most=(1 << 32) - 1)
ROUNDS, HUBS, EARLIER = 2, 2, 16
#: Rows of two numbers that may be broadcast to find the texts of nodes: 16 MB.
BROADCAST_ROWS = 1_000_000


def shingles(text: bytes, n: int, word: common.WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles (of the whole sequence if shorter) of the lower-cased text."""
    h = word.of(text.translate(common.LOWER).split())
    if not len(h):
        return h
    return np.unique(common.windows(h, n)) if len(h) >= n else common.windows(h, len(h), salt=1000 + len(h))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def profiles(slim: DataFrame, n: int, pct: int) -> DataFrame:
    """(doc, dig, size, n1, n2, prefix): n1 and n2 name the set; prefix has its rarest columns (empty for an empty set)."""

    def hashes(batches):
        word = common.WordHashes()
        for b in batches:
            sets = [shingles(t, n, word) for t in common.texts(b)]
            if sets:
                yield np.concatenate(sets)

    counts = build(slim.select("text"), hashes, FREQUENCY)
    sent = slim.sparkSession.sparkContext.broadcast(counts)
    level = max(float(counts.mean()), 1.0)

    def run(batches):
        word = common.WordHashes()
        for b in batches:
            sizes, names, prefix = [], [], []
            for t in common.texts(b):
                s = shingles(t, n, word)
                sizes.append(len(s))
                if not len(s):
                    names.append((None, None))
                    prefix.append(np.empty(0, np.int64))
                    continue
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                names.append((signed(h >> 64), signed(h & 0xFFFFFFFFFFFFFFFF)))
                take = len(s) - (pct * len(s) + 99) // 100 + 1
                kind = (4 * np.log2(np.maximum(FREQUENCY.estimate(sent.value, s) / level, 1))).astype(np.int8)  # 0: rare
                prefix.append((s[np.argsort(kind, kind="stable")[:take]] if kind.any() else s[:take]).view(np.int64))
            n1, n2 = zip(*names, strict=True) if names else ((), ())
            yield pa.RecordBatch.from_arrays([common.column(b, "doc"), common.column(b, "dig"), pa.array(sizes, pa.int64()), pa.array(n1, pa.int64()), pa.array(n2, pa.int64()), lists(prefix)], ["doc", "dig", "size", "n1", "n2", "prefix"])

    return slim.mapInArrow(common.freeing(run), "doc long, dig long, size long, n1 long, n2 long, prefix array<long>")


def lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64()))


def linked(slim: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, pct: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * common >= pct * union. Texts travel, as they are smaller than their sets; a's text, many pairs', comes last."""
    wanted = common.written(nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "node").select("node", F.col("first.doc").alias("doc"), F.col("first.dig").alias("dig")), "wanted")
    small = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    found = slim.alias("s").join(small.alias("w"), common.same(F.col("s.doc"), F.col("w.doc")) & (F.col("s.dig") == F.col("w.dig")))
    texts = common.written(found.select("w.node", "s.text").dropDuplicates(["node"]), "texts")
    both = pairs.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")

    def run(batches):
        word, last, p = common.WordHashes(), None, None
        for batch in batches:
            keep = []
            a, x = common.column(batch, "a").to_pylist(), common.column(batch, "x")
            for i, y in enumerate(common.texts(batch, "y")):
                if a[i] != last:
                    last, p = a[i], shingles(x[i].as_py(), n, word)
                q = shingles(y, n, word)
                at = np.searchsorted(p, q)
                inner = int((p[np.minimum(at, len(p) - 1)] == q).sum())
                if 100 * inner >= pct * (len(p) + len(q) - inner):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.select("a", "b", "x", "y").mapInArrow(common.freeing(run), "a long, b long")


def needed(pct: int) -> Column:
    """Columns that rows of na and nb columns must share."""
    return F.ceil(pct * (F.col("na") + F.col("nb")) / (100 + pct) - 1e-9)


def sizes_fit(pct: int) -> Column:
    return 100 * F.least("na", "nb") >= pct * F.greatest("na", "nb")


def enough(pct: int) -> Column:
    """Whether c common columns of the prefixes, and those after the prefix that ends first, may be as many as are needed."""
    return F.col("c") + F.greatest("na", "nb") * pct / 100 >= needed(pct)


def prefix_entries(nodes: DataFrame) -> DataFrame:
    """(token, node, size, left, own) of the prefix columns that other nodes' prefixes hold too; left: columns of the node from this one on; own: its prefix columns that no other prefix holds."""
    entries = nodes.select("node", F.col("size").cast("int").alias("size"), F.size("prefix").alias("n_prefix"), F.posexplode("prefix").alias("at", "token"))
    shared = entries.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("token")
    e = common.written(entries.join(common.written(shared, "shared"), "token").select("token", "node", "size", "n_prefix", (F.col("size") - F.col("at")).alias("left")), "prefix")
    many = e.groupBy("node").agg(F.count("*").alias("m"))
    return common.written(e.join(many, "node").select("token", "node", "size", "left", (F.col("n_prefix") - F.col("m")).cast("int").alias("own")), "prefix-own")


def parted(e: DataFrame, parts: DataFrame | None) -> DataFrame:
    """e with the component of each node, columns of one component left out."""
    e = e.drop("part")
    e = e.withColumn("part", F.col("node")) if parts is None else e.join(parts, "node", "left").withColumn("part", F.coalesce("least", "node")).drop("least")
    mixed = e.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("token")
    return common.written(e.join(common.written(mixed, "mixed"), "token"), "prefix-mixed")


def hubs_of(e: DataFrame) -> DataFrame:
    """(token, a, na, ra, p): of each column the node with the fewest columns of its own."""
    hub = e.groupBy("token").agg(F.min(F.struct("own", F.col("node").alias("a"), F.col("size").alias("na"), F.col("left").alias("ra"), F.col("part").alias("p"))).alias("hub"))
    return common.written(hub.select("token", "hub.a", "hub.na", "hub.ra", "hub.p"), "hubs")


def hub_pairs(e: DataFrame, hubs: DataFrame, pct: int) -> DataFrame:
    """(a, b): each node b with the HUBS hubs of other components that it shares most columns with. A row for each entry at most."""
    met = e.select("token", F.col("node").alias("b"), F.col("size").alias("nb"), F.col("left").alias("rb"), "part").join(hubs, "token").where((F.col("part") != F.col("p")) & sizes_fit(pct))
    counts = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.max(F.least("ra", "rb")).alias("place"))
    best = Window.partitionBy("b").orderBy(F.desc("c"), "a")  # of the hubs of one prefix
    return counts.where((F.col("place") >= needed(pct)) & enough(pct)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= HUBS).select("a", "b")


def cross_pairs(e: DataFrame, nodes: DataFrame, pct: int) -> DataFrame:
    """(a, b): nodes of different components that may link by sizes, by the place of their first common column, and by the number of common ones. They meet there, and not at later columns if one of EARLIER each tells that they have met."""
    # a node's first columns tell most pairs that have met before: so many are looked at
    listed = e.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("left", "token")), False), 1, EARLIER).alias("early"))  # of one prefix
    prior = F.transform(F.filter("early", lambda x: x.left > F.col("left")), lambda x: x.token)
    e = common.written(e.join(listed, "node").select("token", "node", "size", "left", "part", prior.alias("prior")), "prefix-prior")
    groups = e.groupBy("token", "part").agg(F.count("*").alias("m"), F.min("size").alias("least"), F.max("size").alias("most"), F.max("left").alias("left"), F.first("prior").alias("prior"))
    groups = common.written(groups.withColumn("prior", F.when(F.col("m") == 1, F.col("prior"))), "prefix-groups")
    of = lambda k, x: groups.select("token", F.col("part").alias(k), F.col("m").alias(f"c{x}"), F.col("least").alias(f"n{x}"), F.col("most").alias(f"m{x}"), F.col("left").alias(f"r{x}"), F.col("prior").alias(f"before_{x}"))
    first = lambda x, y: ~F.coalesce(F.arrays_overlap(x, y), F.lit(False))
    within = (100 * F.col("ma") >= pct * F.col("nb")) & (100 * F.col("mb") >= pct * F.col("na"))  # na, nb: the least sizes, ma, mb: the largest
    place = F.least("ra", "rb") >= needed(pct)
    larger = F.struct("ca", "p") > F.struct("cb", "q")  # the larger group is taken apart first
    meet = of("p", "a").join(of("q", "b"), "token").where(larger & within & place & first("before_a", "before_b")).select("token", "p", "q", "nb", "mb", "rb", "before_b")
    left = e.select("token", F.col("part").alias("p"), F.col("node").alias("a"), F.col("size").alias("na"), F.col("size").alias("ma"), F.col("left").alias("ra"), F.col("prior").alias("before_a"))
    half = meet.join(left, ["token", "p"]).where(within & place & first("before_a", "before_b")).select("token", "q", "a", "na", "ra", "before_a")
    right = e.select("token", F.col("part").alias("q"), F.col("node").alias("b"), F.col("size").alias("nb"), F.col("left").alias("rb"), F.col("prior").alias("before_b"))
    pairs = common.written(half.join(right, ["token", "q"]).where(sizes_fit(pct) & place & first("before_a", "before_b")).select("a", "b", "na", "nb"), "met")
    both = pairs.join(nodes.select(F.col("node").alias("b"), F.col("prefix").alias("y")), "b").join(nodes.select(F.col("node").alias("a"), F.col("prefix").alias("x")), "a")
    return both.withColumn("c", F.size(F.array_intersect("x", "y"))).where(enough(pct)).select("a", "b")


def row_components(docs: DataFrame, n: int, pct: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, dig, size, first) of each row: first is the least (none, doc, dig) of its component, ids before nulls; null for an empty set."""
    common.tuned(docs.sparkSession)
    slim = common.keyed(docs, id_col, text_col)
    rows = common.written(profiles(slim, n, pct), "profiles")
    named = rows.where("size > 0").groupBy("n1", "n2").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "dig")).alias("first"), F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    nodes = common.written(named.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers that the table keeps
    e = rest = parted(prefix_entries(nodes), None)
    links, parts, tried = None, None, None
    for step in range(ROUNDS + 1):
        if step < ROUNDS:
            hubs = hubs_of(rest)
            pairs = hub_pairs(rest, hubs, pct)
            rest = rest.join(hubs.select("token", "a"), "token").where("node != a").drop("a")  # the next hub is another one
        else:
            pairs = cross_pairs(e if parts is None else parted(e, parts), nodes, pct)
        if tried is not None:
            pairs = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(tried, ["lo", "hi"], "left_anti").select("a", "b")
        pairs = common.written(pairs, "pairs")
        if pairs.head(1):
            now = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
            tried = now if tried is None else tried.unionByName(now)
            more = common.written(linked(slim, nodes, pairs, n, pct), "links")
            links = more if links is None else links.unionByName(more)
            if more.head(1):
                parts = common.written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "parts")
        if step + 1 < ROUNDS:
            rest = parted(rest, parts)
    placed = nodes.select("n1", "n2", "node", "first")
    placed = placed.withColumn("part", F.col("node")) if parts is None else placed.join(parts, "node", "left").withColumn("part", F.coalesce("least", "node"))
    firsts = placed.groupBy("part").agg(F.min("first").alias("first"))
    of_node = placed.select("n1", "n2", "part").join(firsts, "part").select("n1", "n2", "first")
    return rows.select("doc", "dig", "size", "n1", "n2").join(of_node, ["n1", "n2"], "left").select("doc", "dig", "size", "first")


def join_components(docs: DataFrame, n: int = 4, pct: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_shingles and component_id, the smallest id that links reach.

    Two rows link if 100 * common >= pct * union of their sets of n-word shingles
    (words between white space, A-Z lower-cased; the whole sequence if shorter). A
    null or empty text, or one without words, has an empty set and links with
    nothing. Rows with null ids take part; a component's id is null only if all its
    ids are. Repeated rows have equal sets and link. Other columns are left behind.
    """
    out = row_components(docs, n, pct, id_col, text_col)
    return out.select(F.col("doc").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("first").isNull(), F.col("doc")).otherwise(F.col("first.doc")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs, all columns whatever their names: of each component the row with the least (id, hash of the text), ids before nulls.

    Rows that share an id are judged by their own texts. Of rows that agree in id and
    text, one stays, whichever; but texts without words under null ids link with
    nothing and all stay. An empty table stays so.
    """
    rows = common.written(row_components(docs, n, pct, id_col, text_col), "components")
    carried = common.carried(docs, id_col, text_col)
    gone = rows.where(F.col("first").isNotNull() & ~(common.same(F.col("doc"), F.col("first.doc")) & (F.col("dig") == F.col("first.dig")))).select("doc", "dig").distinct()
    at = lambda other: common.same(F.col("a.doc"), F.col(f"{other}.doc")) & (F.col("a.dig") == F.col(f"{other}.dig"))
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    left = carried.alias("a").join(gone.alias("g"), at("g"), "left_anti")
    twice = rows.where("doc is not null or size > 0").groupBy("doc", "dig").count().where("count > 1").select("doc", "dig")
    if twice.head(1):
        again = left.alias("a").join(twice.alias("t"), at("t"), "left_semi").dropDuplicates(["doc", "dig"])
        left = left.alias("a").join(twice.alias("t"), at("t"), "left_anti").unionByName(again)
    return left.select("row.*")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(common.table(spark, sf_dir, "documents"), n=4, pct=85)
