"""Line dedup by a tree of log templates.

A fixed-depth tree files each line by its number of tokens and its leading tokens; tokens with a digit
are variable. Within a leaf, positions where most lines agree are constants and the others are variable
fields; lines that match enough constants share a template. Lines of templates that recur across
documents are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import arrow_rows, forget, raw, stored

VARIABLE = b"<*>"
#: Leading tokens of a leaf.
DEPTH = 3
#: Share of a line's tokens that must be constants of a template for the line to have it.
SIMILARITY = 0.7
MIN_DOCS, MIN_TOKENS = 3, 4
#: Places beside the main one of copies count beyond so many times what edits on both sides make by chance.
EDITS = 2
#: Tokens a task remembers the hash of; beyond that it starts anew.
MEMO = 150_000
#: Up to so many leaves are sent to all executors; more of them are joined by a shuffle.
BROADCAST_LEAVES = 1_000_000

_DIGIT = re.compile(rb"[0-9]")


def tokens_of(line: bytes) -> list[bytes]:
    """Tokens of a line, A-Z lower-cased; those with a digit are one variable."""
    tokens = line.lower().split()
    if _DIGIT.search(line):
        tokens = [VARIABLE if _DIGIT.search(t) else t for t in tokens]
    return tokens


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def leaf_of(tokens: list[bytes], depth: int = DEPTH) -> int:
    return _hash(b"%d " % len(tokens) + b" ".join(tokens[:depth]))


def _keyed(docs: DataFrame) -> DataFrame:
    """Every document by a key of its doc_id and text, so that repeated rows are one document."""
    return docs.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def _lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """key, line, leaf, kind (hash of the line's tokens), before and after of the lines that have a template.

    `after` stands for the leaves of the lines that follow, up to the next one with a template, `before`
    for those ahead; null where the document has no line there.
    """
    schema = pa.schema(
        [("key", pa.int64()), ("line", pa.int32()), ("leaf", pa.int64()), ("kind", pa.int64()),
         ("before", pa.int64()), ("after", pa.int64())]
    )

    def near(leaves: list[int]) -> int | None:
        return _hash(b"%d " * len(leaves) % tuple(leaves)) if len(leaves) > 1 else leaves[0] if leaves else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                leaves, found = [], []
                for number, line in enumerate((text.as_py() or b"").split(b"\n")):
                    tokens = tokens_of(line)
                    if tokens:
                        leaves.append(leaf_of(tokens, depth))
                        if len(tokens) >= min_tokens and 2 * tokens.count(VARIABLE) <= len(tokens):
                            found.append((len(leaves) - 1, number, _hash(b" ".join(tokens))))
                for k, (at, number, kind) in enumerate(found):
                    low = found[k - 1][0] if k else 0
                    high = found[k + 1][0] + 1 if k + 1 < len(found) else len(leaves)
                    sides = near(leaves[low:at]), near(leaves[at + 1 : high])
                    for column, value in zip(out, (key, number, leaves[at], kind, *sides)):
                        column.append(value)
            yield arrow_rows(schema, out)

    keyed = _keyed(docs).select("__key", raw())
    return keyed.mapInArrow(parse, "key long, line int, leaf long, kind long, before long, after long")


def _in_documents(lines: DataFrame, by: str, min_docs: int) -> DataFrame:
    return lines.groupBy(by).agg(F.countDistinct("key").alias("docs")).filter(F.col("docs") >= min_docs)


def _usual(lines: DataFrame, by: str, side: str) -> DataFrame:
    """The neighbour on one side that more than half of the lines with a value of `by` have, if there is one."""
    held = lines.groupBy(by, side).agg(F.count("*").alias("held"))
    most = held.groupBy(by).agg(F.sum("held").alias("all"), F.max(F.struct("held", side)).alias("top"))
    usual = most.filter((F.col("top.held") * 2 > F.col("all")) & F.col("top")[side].isNotNull())
    return usual.select(by, F.col("top")[side].alias(f"usual_{side}"))


def _around(lines: DataFrame, often: DataFrame, by: str) -> DataFrame:
    """Lines with values of `often`; before and after are the neighbours of the block that a line stands in.

    A block goes on as long as each line has its usual neighbour. A neighbour is null where the block
    reaches the end of the document, or where a later line of it lacks its usual neighbour, as in
    edited copies; a line that itself lacks it has the neighbour it has.
    """
    usual = often.select(by, F.lit(True).alias("often"))
    for side in ("after", "before"):
        usual = usual.join(_usual(lines, by, side), by, "left")
    known = lines.join(stored(usual, "usual"), by, "left")
    # Of a line only what its block asks of it is shuffled: its neighbour if the block ends with it, and whether that is odd.
    slim = ["key", "line", F.when(F.col("often"), F.col(by)).alias(by), "often"]
    for side in ("after", "before"):
        own, most = F.col(side), F.col(f"usual_{side}")
        ends = own.isNotNull() & ~own.eqNullSafe(most)
        slim += [F.when(ends, own).alias(side), F.when(ends, most.isNotNull()).alias(f"odd_{side}")]
    known = known.select(*slim).repartition("key")
    for side, order in (("after", F.desc("line")), ("before", F.asc("line"))):
        stop = F.when(F.col(side).isNotNull(), F.struct("line", F.col(side).alias("side"), F.col(f"odd_{side}").alias("odd")))
        onwards = Window.partitionBy("key").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        known = known.withColumn("stop", F.last(stop, ignorenulls=True).over(onwards))
        within = F.col("stop.odd") & (F.col("stop.line") != F.col("line"))
        known = known.withColumn(f"outer_{side}", F.when(~within, F.col("stop.side"))).drop("stop")
    outer = known.filter("often")
    return outer.select("key", by, F.col("outer_before").alias("before"), F.col("outer_after").alias("after"))


def _main(places: DataFrame, by: str, side: str) -> DataFrame:
    """The most frequent neighbour of the blocks on one side, and whether more than half have it."""
    held = places.groupBy(by, side).agg(F.sum("held").alias("n"))
    most = held.groupBy(by).agg(F.sum("n").alias("all"), F.max(F.struct("n", side)).alias("top"))
    return most.select(by, F.col(f"top.{side}").alias(f"main_{side}"), (F.col("top.n") * 2 > F.col("all")).alias(f"most_{side}"))


def _recurring(lines: DataFrame, by: str, min_docs: int) -> DataFrame:
    """Values of `by` that stand in at least `min_docs` documents and independent places.

    A place is the pair of neighbours of the whole block that a line stands in (see `_around`). Where
    one side is mostly the same, as at a header or footer, the other side alone makes the place. A
    place is independent if it is the most frequent one both with its neighbour before and with its
    neighbour after: near copies of a document, edited on one side, so make one place. Where both
    sides are mostly the same, the copies edited on both sides are estimated from those edited on
    one, and places count beyond EDITS times as many.
    """
    often = stored(_in_documents(lines, by, min_docs), "recurring")
    around = _around(lines, often, by)
    places = stored(around.groupBy(by, "before", "after").agg(F.countDistinct("key").alias("held")), "places")
    sides = places.join(_main(places, by, "before"), by).join(_main(places, by, "after"), by)
    plain = {
        side: F.col(side).isNull() | (F.col(f"most_{side}") & F.col(side).eqNullSafe(F.col(f"main_{side}")))
        for side in ("before", "after")
    }
    both = F.col("most_before") & F.col("most_after")
    sides = sides.select(
        by,
        "held",
        F.when(plain["before"] & ~F.col("most_after"), F.xxhash64(F.lit("first"), "after")).otherwise(F.col("before")).alias("before"),
        F.when(plain["after"] & ~F.col("most_before"), F.xxhash64(F.lit("last"), "before")).otherwise(F.col("after")).alias("after"),
        F.when(both, plain["before"].cast("int") + 2 * plain["after"].cast("int")).alias("cell"),
    )
    merged = sides.groupBy(by, "before", "after").agg(F.sum("held").alias("held"), F.max("cell").alias("cell"))
    best_before = F.max(F.struct("held", "after")).over(Window.partitionBy(by, "before"))
    best_after = F.max(F.struct("held", "before")).over(Window.partitionBy(by, "after"))
    independent = F.col("b.after").eqNullSafe(F.col("after")) & F.col("a.before").eqNullSafe(F.col("before"))
    cells = [F.sum(F.when(F.col("cell") == k, F.col("held")).otherwise(0)).alias(f"cell{k}") for k in (1, 2, 3)]
    counted = (
        merged.withColumns({"b": best_before, "a": best_after}).groupBy(by)
        .agg(F.sum(independent.cast("int")).alias("places"), *cells)
    )
    chance = F.col("cell1") * F.col("cell2") / F.greatest("cell3", F.lit(1))
    return counted.filter(F.col("places") >= min_docs + EDITS * chance)


def _tokens(docs: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """leaf, kind, tokens (hashed, in order) of every distinct line in the given leaves."""
    schema = pa.schema([("leaf", pa.int64()), ("kind", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    few = leaves.count() <= BROADCAST_LEAVES
    wanted = np.sort(leaves.toArrow()["leaf"].to_numpy()) if few else None
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        names: dict[bytes, int] = {}
        chosen = set(shared.value.tolist()) if shared.value is not None else None
        for batch in batches:
            seen: dict[int, tuple[int, list[int]]] = {}
            for text in batch.column(0):
                for line in (text.as_py() or b"").split(b"\n"):
                    tokens = tokens_of(line)
                    leaf = leaf_of(tokens, depth)
                    if chosen is not None and leaf not in chosen:
                        continue
                    kind = _hash(b" ".join(tokens))
                    if kind not in seen:
                        if len(names) > MEMO:
                            names.clear()
                        seen[kind] = leaf, [names.get(t) or names.setdefault(t, _hash(t)) for t in tokens]
            yield arrow_rows(schema, [[v[0] for v in seen.values()], list(seen), [v[1] for v in seen.values()]])

    found = docs.select(raw()).mapInArrow(parse, "leaf long, kind long, tokens array<long>")
    if not few:
        found = found.join(leaves, "leaf", "left_semi")
    return found.dropDuplicates(["kind"])


def templates(docs: DataFrame, lines: DataFrame, depth: int, similarity: float, min_docs: int) -> DataFrame:
    """kind, template of the lines that a generalised template takes; all other lines are their own template.

    The constants of a group of lines, at first a leaf, are the tokens that more than half of its
    documents and lines have at a position, a line counting once for each document that holds it. A
    group that gave a template is tried again with the lines left over. One that gave none is split:
    each line goes with the most frequent token, at its position, that it shares with only a part of the
    group. This ends when no group is left; lines go that share no further token with `min_docs` documents.
    """
    leaves = _in_documents(lines, "leaf", min_docs).join(
        lines.groupBy("leaf").agg(F.min("kind").alias("low"), F.max("kind").alias("high")).filter("low <> high"), "leaf"
    )
    weights = lines.groupBy("kind", "key").agg(F.lit(1).alias("one")).groupBy("kind").agg(F.sum("one").alias("weight"))
    first = _tokens(docs, leaves.select("leaf"), depth).join(weights, "kind")
    left = stored(first.select(F.col("leaf").alias("group"), "kind", "weight", "tokens"), "template-lines")
    taken, k = None, 0
    while taken is None or not left.isEmpty():
        totals = left.groupBy("group").agg(F.sum("weight").alias("total")).filter(F.col("total") >= min_docs)
        cells = left.select("group", "kind", "weight", F.size("tokens").alias("length"), F.posexplode("tokens").alias("at", "token"))
        constant = F.col("held") * 2 > F.col("total")
        held = (
            cells.groupBy("group", "at", "token").agg(F.sum("weight").alias("held"))
            .filter(F.col("held") > 1).join(totals, "group").filter(constant | (F.col("held") >= min_docs))
        )
        shared = F.when((F.col("held") < F.col("total")) & (F.col("held") >= min_docs), F.struct("held", "at", "token"))
        seen = cells.drop("weight").join(held, ["group", "at", "token"]).groupBy("group", "kind").agg(
            (F.sum(constant.cast("int")) >= similarity * F.max("length")).alias("matched"), F.max(shared).alias("next")
        )
        seen = stored(seen, "templates")
        own = seen.filter("matched").select("kind", F.xxhash64("group", F.lit(k)).alias("template"))
        taken = own if taken is None else taken.unionByName(own)
        gave = seen.groupBy("group").agg(F.max("matched").alias("gave"))
        part = F.when(F.col("gave"), F.col("group")).otherwise(F.xxhash64("group", "next.at", "next.token"))
        rest = seen.filter("NOT matched").join(gave, "group").filter("gave OR next IS NOT NULL").select("kind", part.alias("group"))
        left = stored(left.drop("group").join(rest, "kind").select("group", "kind", "weight", "tokens"), "template-lines")
        k += 1
    return taken


def drop_recurring_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_tokens: int = MIN_TOKENS,
    depth: int = DEPTH,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """The documents without lines of recurring templates, with n_lines and n_dropped added.

    A template recurs if lines with it, alone or in a block of lines that recur together, stand in at
    least `min_docs` documents and as many independent places (see `_recurring`). Whole documents that are copies, exact or near, have the same lines
    around it everywhere; their lines stay, for they are no boilerplate but a matter of document
    dedup. Lines with fewer than `min_tokens` tokens, or of which more than half
    are variable, have no template.

    `text` is replaced; all other columns stay as they are, so a column named n_lines or n_dropped is
    overwritten. A null text stays null with 0 lines; a document can be left with an empty text.
    Repeated rows (one doc_id, one text) count as one document and are treated alike. Lines and texts
    of any length are read whole; an empty table gives an empty one.
    """
    lines = stored(_lines(docs, depth, min_tokens), "template-index")
    own = templates(docs, lines, depth, similarity, min_docs)
    template = F.coalesce("template", "kind").alias("template")
    named = stored(lines.join(own, "kind", "left").select("key", "line", template, "before", "after"), "named-lines")
    recurring = _recurring(named, "template", min_docs).select("template")
    dropped = (
        named.join(recurring, "template", "left_semi").groupBy(F.col("key").alias("__drop_key"))
        .agg(F.collect_set("line").alias("__dropped"))
    )
    joined = _keyed(docs).join(dropped, F.col("__key") == F.col("__drop_key"), "left")
    every = F.split(F.col("text").cast("string"), "\n", -1)
    kept = F.array_join(F.filter(every, lambda _, i: ~F.array_contains("__dropped", i)), "\n")
    count = F.coalesce(F.size("__dropped"), F.lit(0))
    changed = joined.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(every)),
            "n_dropped": F.when(F.col("__dropped").isNull(), 0).otherwise(count),
        }
    )
    out = changed.withColumn("text", F.when(F.col("__dropped").isNotNull(), kept).otherwise(F.col("text")))
    return out.drop("__key", "__drop_key", "__dropped")
