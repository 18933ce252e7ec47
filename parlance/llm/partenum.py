"""Near-duplicate documents by an exact Jaccard join on word shingles, with PartEnum signatures.

Sets of similar size share a band. The hashed domain of shingles is cut into partitions, more of them
than the sets of a band may differ in elements. So linked sets agree on the whole content of some
partitions; a signature is one partition's content. Linked sets of which each differs from the other in
at most k elements agree in all but k of their signatures: whatever order all documents agree on, they
share one among the first k + 1. The order puts signatures that many documents have last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import arrow_rows, forget, raw, stored

SHINGLE = 5
PERCENT = 80
#: Partitions for each element of the smallest set of a band, and for all bands of small sets.
PARTITIONS, SMALL_BANDS, SMALL_PARTITIONS = 1.25, 6, 1 << 20
#: Counters by which signatures are found to be frequent; their number bounds what reaches the driver.
COUNTERS = 1 << 19
#: Up to so many documents are looked up by a table sent to all executors; more by a shuffle.
BROADCAST_DOCS = 1_000_000
#: Words a task remembers the hash of; beyond that it starts anew.
MEMO = 150_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles of five words, A-Z lower-cased.

    Fewer words are one shingle, no words none.
    """
    words = (text or b"").lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))][: len(words)], np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = out * _BASE + ids[k : k + n]
    return np.unique(mix(out))


def tolerance(n: int) -> int:
    """Elements in which a set of n may differ from one that it links with: a larger one of n / 0.8 that holds it."""
    return n * (100 - PERCENT) // PERCENT


def bands(n: int) -> list[int]:
    """Bands of a set of n: the power of two below it, and the one before that if sets there can link with it."""
    own = n.bit_length() - 1
    return [own, own - 1] if own and n * PERCENT < (1 << own) * 100 else [own]


def signatures(elements: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature and number of elements of each filled partition."""
    count = SMALL_PARTITIONS if band < SMALL_BANDS else int(PARTITIONS * (1 << band))
    part = ((elements >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)  # rises with the element
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    content = np.add.reduceat(mix(elements), first)
    named = mix(content + mix(part[first] * np.uint64(64) + np.uint64(band)))
    return named, np.diff(np.append(first, len(elements)))


def chosen(elements: np.ndarray, band: int, rank: np.ndarray) -> np.ndarray:
    """The first k + 1 signatures by the common order: seldom ones, then large partitions, then by value.

    A set with no more than k filled partitions gives all of them and a mark of the band: two such
    sets may agree on empty partitions alone.
    """
    named, sizes = signatures(elements, band)
    need = tolerance(len(elements)) + 1
    if len(named) < need:
        return np.append(named, mix(np.array([band], np.uint64)))
    order = np.lexsort((named, -sizes, rank[named % np.uint64(len(rank))]))
    return named[order[:need]]


def _frequencies(docs: DataFrame) -> np.ndarray:
    """How often signatures of each counter occur, as a rank: 0 for the usual, higher for each doubling beyond."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes, total, seen = WordHashes(), np.zeros(COUNTERS, np.int64), set()
        for batch in batches:
            for text in batch.column(0):
                elements = shingles(text.as_py(), hashes)
                if not len(elements) or (same := int(elements.sum())) in seen:
                    continue
                seen.add(same)
                for band in bands(len(elements)):
                    cells = signatures(elements, band)[0] % np.uint64(COUNTERS)
                    np.add.at(total, cells.astype(np.int64), 1)
        found = np.flatnonzero(total)
        yield arrow_rows(schema, [found, total[found]])

    counted = docs.select(raw()).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(COUNTERS, np.int64)
    total[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    usual = 4 * total.mean() + 16
    return np.log2(np.maximum(total / usual, 1)).astype(np.int8)


def _index(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """doc_id, key, n, node (hash of the set), sigs; of equal sets in a task only one has signatures."""
    shared = docs.sparkSession.sparkContext.broadcast(rank)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sigs", pa.list_(pa.int64()))]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes, seen = WordHashes(), set()
        for batch in batches:
            n, nodes, sigs = [], [], []
            for text in batch.column(2):
                elements = shingles(text.as_py(), hashes)
                n.append(len(elements))
                node = int(mix(elements).sum(dtype=np.uint64).astype(np.int64)) if len(elements) else None
                nodes.append(node)
                if node is None or node in seen:
                    sigs.append([])
                    continue
                seen.add(node)
                own = [chosen(elements, band, shared.value) for band in bands(len(elements))]
                sigs.append(np.concatenate(own).view(np.int64))
            yield arrow_rows(schema, [batch.column(0), batch.column(1), n, nodes, sigs])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), raw())
    return rows.mapInArrow(build, "doc_id long, key long, n long, node long, sigs array<long>")


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, elements of the documents in wanted (key, node), one for each node."""
    schema = pa.schema([("node", pa.int64()), ("elements", pa.list_(pa.int64()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(text.as_py(), hashes).view(np.int64) for text in batch.column(1)]
            yield arrow_rows(schema, [batch.column(0), sets])

    few = wanted.count() <= BROADCAST_DOCS
    found = docs.select(_key().alias("key"), raw()).join(F.broadcast(wanted) if few else wanted, "key")
    return found.select("node", "text").mapInArrow(build, "node long, elements array<long>")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with sizes n_a, n_b, the number of `common` elements and whether they are `linked`.

    `own`: the elements of b that a lacks.
    """
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("of_b"))
    joined = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    sized = joined.withColumns(
        {"n_a": F.size("of_a"), "n_b": F.size("of_b"), "common": F.size(F.array_intersect("of_a", "of_b"))}
    )
    united = F.col("n_a") + F.col("n_b") - F.col("common")
    return sized.select(
        "a",
        "b",
        "n_a",
        "n_b",
        "common",
        (100 * F.col("common") >= PERCENT * united).alias("linked"),
        F.array_except("of_b", "of_a").alias("own"),
    )


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes of the edges (a, b).

    Every node takes the smallest label around it and then that label's label, until nothing changes.
    """
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        nearer = labels.join(around, F.col("node") == F.col("a")).select(
            "node", F.least("component", "near").alias("to"), F.col("component").alias("old")
        )
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("next"))
        moved = stored(nearer.join(jump, "to").select("node", F.least("to", "next").alias("component"), "old"), "labels")
        changed = moved.filter(F.col("component") != F.col("old")).limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels


def _buckets(index: DataFrame) -> DataFrame:
    """sig, node, place of all sets that share a signature with another one.

    Places order a bucket by how many sets its members meet in all their buckets: an original, of
    which many near copies differ more from each other than from it, comes before them.
    """
    rows = index.select("node", F.explode("sigs").alias("sig"))
    shared = (
        rows.repartition("sig").dropDuplicates(["sig", "node"])
        .withColumn("met", F.count("*").over(Window.partitionBy("sig"))).filter("met > 1")
    )
    shared = stored(shared, "buckets")
    central = shared.groupBy(F.col("node").alias("member")).agg(F.sum("met").alias("meets"))
    order = Window.partitionBy("sig").orderBy(F.desc("meets"), "node")
    placed = shared.join(central, F.col("node") == F.col("member")).withColumn("place", F.row_number().over(order))
    return stored(placed.select("sig", "node", "place"), "buckets")


#: What two sets, x and y, need of their comparison with a leader.
MET = ("a", "b", "n_b", "component", "home", "linked", "more", "less")


def _may_link(shared: Column) -> Column:
    """Whether x and y may link if they share up to so many elements that their leader lacks.

    Their difference is at least that of the elements beyond the leader and that of the leader's own.
    """
    beyond = F.expr("x.more + y.more + abs(x.less - y.less)")
    room = F.floor((F.col("x.n_b") + F.col("y.n_b")) * (100 - PERCENT) / (100 + PERCENT))
    apart = F.expr("x.b <> y.b and x.component <> y.component and (x.home <> y.home or x.home = x.a) and (y.linked or x.b < y.b)")
    return apart & (100 * F.least("x.n_b", "y.n_b") >= PERCENT * F.greatest("x.n_b", "y.n_b")) & (beyond - 2 * shared <= room)


def _sharing(named: DataFrame, beyond: DataFrame) -> DataFrame:
    """Pairs (xb, yb) of sets that may link, and share elements that their leader lacks.

    A set r with m elements beyond the leader links there only with sets that share m - |r| / 5 of them
    or more. Only elements count that sets of different components hold. A set with too few of these
    goes; of the others, in the order seldom ones first, all but as many as must be shared less one are
    joined: sets that share that many share one of those.
    """
    rows = beyond.join(named.select("a", "b", "component", "linked"), ["a", "b"])
    # An element of a leader's group, as one number; of two that are alike, both are shared by more sets.
    element = F.explode(F.transform("own", lambda e: F.xxhash64("a", e)))
    rows = rows.select("a", "b", "component", "linked", element.alias("element")).repartition("element")
    group = Window.partitionBy("element")
    held = rows.select(
        "a", "b", "element", F.count("*").over(group).alias("often"),
        (F.min("component").over(group) != F.max("component").over(group)).alias("mixed"), F.min("linked").over(group).alias("liked"),
    ).filter("mixed and not liked")
    listed = held.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("often", "element"))).alias("held"))
    need = F.greatest(F.lit(1), F.col("more") - F.floor(F.col("n_b") * (100 - PERCENT) / 100)).cast("int")
    able = named.select(*MET).join(listed, ["a", "b"]).withColumns({"count": F.size("held"), "need": need}).filter("count >= need")
    first = able.select(*MET, "count", F.explode(F.slice("held", F.lit(1), F.col("count") - F.col("need") + 1)).alias("e"))
    first = stored(first.select(*MET, "count", F.col("e.element").alias("element")), "elements")
    x, y = first.filter(~F.col("linked")).alias("x"), first.alias("y")
    met = x.join(y, F.expr("x.a = y.a and x.element = y.element") & _may_link(F.least("x.count", "y.count")))
    return met.select(F.col("x.b").alias("xb"), F.col("y.b").alias("yb")).distinct()


def _further(compared: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that were compared with one leader, are in different components, and may link.

    Let r be unlike the leader L, and s another set that was compared with L. What they share of the
    elements that L lacks, and how many of L's each lacks, bounds their difference from below. So they link
    only if (i) they share enough such elements (see `_sharing`), or (ii) they share none, and what both
    have beyond L is little; then s is so much smaller than L that 9 * (d + |s| - |L|) <= |r| + |s|, d the difference of
    r and L, which is a join on the size of s. Two sets whose home, the leader of most sets among those
    they were compared with, is the same are looked at there alone.
    """
    led = compared.groupBy(F.col("a").alias("leader")).agg(F.count("*").alias("members"))
    met = compared.select(F.col("b").alias("set"), F.col("a").alias("leader")).unionByName(
        led.select(F.col("leader").alias("set"), "leader")
    )
    homes = met.join(led, "leader").groupBy("set").agg(F.max(F.struct("members", "leader"))["leader"].alias("home"))
    named = compared.drop("own").join(labels.withColumnRenamed("node", "l"), F.col("b") == F.col("l"), "left")
    named = named.join(homes, F.col("b") == F.col("set")).select(
        "a", "b", "n_a", "n_b", "common", "linked", "home", F.coalesce("component", "b").alias("component")
    )
    mixed = named.groupBy("a").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("a")
    named = stored(named.join(mixed, "a"), "unsettled")
    more, less = F.col("n_b") - F.col("common"), F.col("n_a") - F.col("common")
    named = named.withColumns({"more": more, "less": less})
    # (ii): sizes that s can have, from the least that fits r.
    d = F.col("n_a") + F.col("n_b") - 2 * F.col("common")
    most = F.floor((9 * (F.col("n_a") - d) + F.col("n_b")) / 8).cast("int")
    least = F.ceil(F.col("n_b") * PERCENT / 100).cast("int")
    r = named.filter(~F.col("linked")).withColumns({"least": least, "most": most}).filter("most >= least")
    r = r.select(*MET, F.explode(F.sequence("least", "most")).alias("size")).alias("x")
    smaller = r.join(named.select(*MET).alias("y"), F.expr("x.a = y.a and x.size = y.n_b") & _may_link(F.lit(0)))
    smaller = smaller.select(F.col("x.b").alias("xb"), F.col("y.b").alias("yb"))
    both = _sharing(named, compared.select("a", "b", "own")).unionByName(smaller)
    return both.select(F.least("xb", "yb").alias("a"), F.greatest("xb", "yb").alias("b")).distinct()


def link_sets(docs: DataFrame, index: DataFrame) -> DataFrame | None:
    """node, component of the sets that link with another one; None if there are no such sets.

    The first member of each bucket, its leader, is compared with all others. What two other members
    have in common with it tells whether they can link; only such pairs are compared in turn. So no
    bucket is paired up, and no link is lost.
    """
    buckets = _buckets(index)
    if not buckets.limit(1).count():
        return None
    first, other = buckets.filter("place = 1").alias("f"), buckets.filter("place > 1").alias("o")
    pairs = first.join(other, F.expr("f.sig = o.sig")).select(F.col("f.node").alias("a"), F.col("o.node").alias("b"))
    pairs = stored(pairs.distinct(), "pairs")
    keys = index.filter(F.size("sigs") > 0).groupBy("node").agg(F.min("key").alias("key"))
    nodes = buckets.select("node").distinct()
    sets = stored(_sets(docs, keys.join(nodes, "node")).dropDuplicates(["node"]), "sets")
    compared = stored(_compared(pairs, sets), "compared")
    edges = compared.filter("linked").select("a", "b")
    further = stored(_further(compared, components(edges)), "pairs")
    if further.limit(1).count():
        linked = stored(_compared(further, sets).filter("linked").select("a", "b"), "linked")
        edges = edges.unionByName(linked)
    return components(edges)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, component_id, component of every row: one class of near duplicates a component.

    Two documents link when their sets of distinct five-word shingles have a Jaccard similarity of
    0.8 or more, compared in whole numbers on 64-bit hashes; components join what links reach, and
    component_id is their smallest doc_id. A document with fewer than five words has its word sequence
    as one shingle; one without words (or a null text) has none, links with nothing and is its own
    component. Equal sets, also of repeated rows, are one node of the graph, so copies are not paired.
    A null doc_id is only a component_id where no document of the component has one. Texts of any
    length are compared whole; an empty table gives an empty one; other columns are not read.
    `key` is a hash of doc_id and text, `component` a number of the component (null without words).
    """
    index = stored(_index(docs, _frequencies(docs)), "shingle-index")
    labels = link_sets(docs, index)
    named = index.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    if labels is None:
        named = named.select("node", F.col("node").alias("component"), F.col("least").alias("component_id"))
    else:
        owned = named.join(labels.withColumnRenamed("node", "l"), F.col("node") == F.col("l"), "left").select(
            "node", "least", F.coalesce("component", "node").alias("component")
        )
        least = owned.groupBy("component").agg(F.min("least").alias("component_id"))
        named = owned.join(least, "component").select("node", "component", "component_id")
    rows = index.select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("node").alias("own"))
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(named, F.col("own") == F.col("node"), "left").select(
        "doc_id", "key", "n_shingles", own.alias("component_id"), "component"
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each component the one with the smallest doc_id stays.

    A null doc_id comes last; of repeated rows (one doc_id, one text) one stays; documents without words
    stay. All columns are returned as they are.
    """
    near = stored(near_duplicates(docs), "near-duplicates")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    best = near.filter("component is not null").groupBy("component").agg(F.min(order).alias("best")).select(F.col("best.key").alias("key"))
    dropped = near.filter("component is not null").select("key").join(best, "key", "left_anti").distinct()
    repeated = near.groupBy("key").count().filter("count > 1").select("key")
    marks = (
        dropped.withColumn("drop", F.lit(True)).unionByName(repeated.withColumn("drop", F.lit(False)))
        .groupBy(F.col("key").alias("__marked")).agg(F.max("drop").alias("__drop"))
    )
    few = marks.count() <= BROADCAST_DOCS
    # The rows travel packed, so that no name of theirs meets one of these.
    keyed = docs.select(_key().alias("__key"), F.struct(*docs.columns).alias("__row"))
    joined = keyed.join(F.broadcast(marks) if few else marks, F.col("__key") == F.col("__marked"), "left")
    single = joined.filter(F.col("__marked").isNull())
    several = joined.filter(F.col("__marked").isNotNull() & ~F.col("__drop")).dropDuplicates(["__key"])
    return single.unionByName(several).select("__row.*")
