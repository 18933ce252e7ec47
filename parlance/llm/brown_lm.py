"""Brown class-based bigram model of words.

P(word | previous word) = P(class | previous class) * P(word | class). Exchange clustering puts frequent
words into classes; a rarer word belongs to the class of its ending, and endings are clustered together
with the frequent words. Word counts, of which there are as many as the corpus has words, stay a Spark
table; class tables are bounded by the number of classes and clustered units.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_rows, raw, stored

END = b""
#: Frequent words that are units of their own, and units that share all other words by their ending.
OWN_UNITS, ENDING_UNITS = 4000, 1000
ENDING_BYTES = 3
CLASSES = 64
SWEEPS = 6
#: Most frequent words whose counts every task holds; the counts of the others are joined.
HELD_WORDS = 60_000
#: Entries of a task's counters before they are passed on.
FLUSH = 400_000
ADD = 0.5


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, then the end token."""
    return [*(text or b"").lower().split(), END]


class Units(dict):
    """Number of a word's unit: 0 the end, then the frequent words, then the endings."""

    def __init__(self, own: list[bytes]):
        super().__init__({END: 0, **{w: k + 1 for k, w in enumerate(own)}})
        self.own = len(own) + 1

    def __missing__(self, word: bytes) -> int:
        number = self.own + xxhash.xxh32_intdigest(word[-ENDING_BYTES:]) % ENDING_UNITS
        if len(self) < FLUSH:
            self[word] = number
        return number


def _count_words(training: DataFrame) -> DataFrame:
    """word, n of all training tokens."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
                if len(seen) > FLUSH:
                    yield arrow_rows(schema, [list(seen), list(seen.values())])
                    seen = Counter()
        yield arrow_rows(schema, [list(seen), list(seen.values())])

    return training.select(raw()).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _count_pairs(training: DataFrame, own: list[bytes]) -> DataFrame:
    """u, v, n: how often unit v follows unit u; the end unit stands before the first word."""
    shared = training.sparkSession.sparkContext.broadcast(own)
    schema = pa.schema([("u", pa.int32()), ("v", pa.int32()), ("n", pa.int64())])
    width = len(own) + 1 + ENDING_UNITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(shared.value)

        def summed(codes: list[np.ndarray]) -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(codes), return_counts=True)
            return arrow_rows(schema, [pairs // width, pairs % width, n])

        codes: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                ids = np.fromiter(map(units.__getitem__, words), np.int64, len(words))
                codes.append(np.concatenate(([0], ids[:-1])) * width + ids)
                held += len(ids)
                if held > 8_000_000:
                    yield summed(codes)
                    codes, held = [], 0
        if codes:
            yield summed(codes)

    pairs = training.select(raw()).mapInArrow(count, "u int, v int, n long")
    return pairs.groupBy("u", "v").agg(F.sum("n").alias("n"))


def exchange(pairs: DataFrame, units: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit, by the exchange algorithm on the likelihood of class bigrams.

    A sweep counts in Spark how often each unit stands before and after each class; every unit then
    moves to the class that raises the likelihood most, with the class counts kept up to date. What
    reaches the driver is units x classes numbers. Ties go to the class with the lowest number.
    """
    spark = pairs.sparkSession
    classes = min(classes, units)
    where = np.arange(units) % classes
    where[0] = 0
    best = (-np.inf, where)
    for sweep in range(sweeps + 1):
        named = spark.createDataFrame([(int(u), int(c)) for u, c in enumerate(where)], "w int, c int")
        after = pairs.join(F.broadcast(named), F.col("v") == F.col("w")).groupBy("u", "c").agg(F.sum("n").alias("n"))
        ahead = pairs.join(F.broadcast(named), F.col("u") == F.col("w")).groupBy("v", "c").agg(F.sum("n").alias("n"))
        follow, before = np.zeros((units, classes)), np.zeros((units, classes))
        for table, column, into in ((after, "u", follow), (ahead, "v", before)):
            got = table.toArrow()
            into[got[column].to_numpy(), got["c"].to_numpy()] = got["n"].to_numpy()
        joint = np.zeros((classes, classes))
        np.add.at(joint, where, follow)
        value = _objective(joint)
        if value <= best[0]:
            break
        best = (value, where.copy())
        if sweep < sweeps:
            where = _sweep(where.copy(), follow, before, joint)
    return best[1]


def _xlog(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _objective(joint: np.ndarray) -> float:
    return float(_xlog(joint).sum() - _xlog(joint.sum(axis=0)).sum() - _xlog(joint.sum(axis=1)).sum())


def _sweep(where: np.ndarray, follow: np.ndarray, before: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """Each unit but the end, most frequent first, moves to its best class."""
    for u in sorted(range(1, len(where)), key=lambda u: (-before[u].sum(), u)):
        f, b, old = follow[u], before[u], where[u]
        if not b.sum():
            continue
        joint[old] -= f
        joint[:, old] -= b
        joint = np.maximum(joint, 0)  # pairs of two units of one class are taken off twice
        rows, columns = joint.sum(axis=1), joint.sum(axis=0)
        gain = (
            (_xlog(joint + f) - _xlog(joint)).sum(axis=1)
            + (_xlog(joint.T + b) - _xlog(joint.T)).sum(axis=1)
            - (_xlog(rows + f.sum()) - _xlog(rows))
            - (_xlog(columns + b.sum()) - _xlog(columns))
        )
        new = int(np.argmax(gain))
        where[u] = new
        joint[new] += f
        joint[:, new] += b
    return where


def score_documents(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Scores of every row of `docs` under a model learnt from all texts of `training`.

    Columns: doc_id, n_tokens, n_known (tokens seen in training), train_tokens, base_score (log10
    probability under smoothed word counts), score (under the class model), perplexity (of score, a token).
    Tokens are the words, A-Z lower-cased, and one end; a null or empty text is the end alone.
    Unseen words get the share of one unseen word of their class. Each row is scored on its own, also
    a repeated one. With no training rows every token is unseen. Texts of any length are scored
    whole; an empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    counted = stored(_count_words(training), "brown-words")
    total, kinds = counted.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    frequent = counted.filter(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(HELD_WORDS).toArrow()
    held = dict(zip(frequent["word"].to_pylist(), frequent["n"].to_pylist()))
    own = list(held)[:OWN_UNITS]
    pairs = stored(_count_pairs(training, own), "brown-pairs")
    n_units = len(own) + 1 + ENDING_UNITS
    where = exchange(pairs, n_units)
    classes = int(where.max()) + 1

    named = spark.createDataFrame([(int(u), int(c)) for u, c in enumerate(where)], "w int, c int")
    joint = np.zeros((classes, classes))
    from_c, to_c = F.broadcast(named.select(F.col("w").alias("u"), F.col("c").alias("cu"))), F.broadcast(
        named.select(F.col("w").alias("v"), F.col("c").alias("cv"))
    )
    got = pairs.join(from_c, "u").join(to_c, "v").groupBy("cu", "cv").agg(F.sum("n").alias("n")).toArrow()
    joint[got["cu"].to_numpy(), got["cv"].to_numpy()] = got["n"].to_numpy()
    vocabulary = _class_sizes(counted, own, where, classes)
    tokens = joint.sum(axis=0)
    # Transitions back off to the share of the class, with the weight of one occurrence for each class seen after.
    marginal = (tokens + ADD) / (tokens.sum() + ADD * classes)
    spread = np.maximum((joint > 0).sum(axis=1, keepdims=True), 1)
    transition = np.log10((joint + spread * marginal) / (joint.sum(axis=1, keepdims=True) + spread))
    emission = -np.log10(tokens + ADD * (vocabulary + 1))  # to be added to log10(count + ADD)
    ends = counted.filter(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0
    held[END] = ends
    shared = spark.sparkContext.broadcast((held, own, where, transition, emission))
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()),
         ("logs", pa.float64()), ("model", pa.float64()), ("word", pa.binary()), ("n", pa.int64())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names, member, moves, emits = shared.value
        units = Units(names)
        logs = {w: float(np.log10(n + ADD)) for w, n in counts.items()}
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for row, doc, text in zip(*(batch.column(k) for k in range(3))):
                words = words_of(text.as_py())
                ids = np.fromiter(map(units.__getitem__, words), np.int64, len(words))
                own_classes = member[ids]
                model = moves[np.concatenate(([member[0]], own_classes[:-1])), own_classes].sum() + emits[own_classes].sum()
                found = list(map(logs.get, words))
                rest = Counter(w for w, x in zip(words, found) if x is None) if None in found else {}
                first = [row.as_py(), doc.as_py(), len(words), 0, 0.0, float(model), b" %d" % row.as_py(), 0]
                first[3] = len(words) - sum(rest.values()) - (0 if counts[END] else 1)
                first[4] = sum(x for x in found if x is not None)
                for column, value in zip(out, first):
                    column.append(value)
                n = len(rest)
                for column, values in zip(out, ([first[0]] * n, [None] * n, [0] * n, [0] * n, [0.0] * n, [0.0] * n, rest, rest.values() if rest else ())):
                    column.extend(values)
            yield arrow_rows(schema, out)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), raw())
    # A row for the document itself (its word holds a space, as no word does) and one for each rarer word.
    parts = rows.mapInArrow(score, "row long, doc_id long, n_tokens long, known long, logs double, model double, word binary, n long")
    rare = counted.select(F.col("word").alias("w"), F.col("n").alias("c"))
    joined = parts.join(rare, F.col("word") == F.col("w"), "left")
    c = F.coalesce("c", F.lit(0))
    per_row = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(c > 0, F.col("n")).otherwise(0))).alias("n_known"),
        (F.sum("logs") + F.sum(F.col("n") * F.log10(c + ADD))).alias("logs"),
        F.sum("model").alias("model"),
    )
    floor = float(np.log10(total + ADD * (kinds + 1)))
    scored = per_row.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("logs") + F.col("model")).alias("score"),
    )
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _class_sizes(counted: DataFrame, own: list[bytes], where: np.ndarray, classes: int) -> np.ndarray:
    """Distinct words of each class."""
    shared = counted.sparkSession.sparkContext.broadcast((own, where))
    schema = pa.schema([("c", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, member = shared.value
        units = Units(names)
        totals = np.zeros(classes, np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            totals += np.bincount(member[[units[w] for w in words]], minlength=classes) if words else 0
        yield arrow_rows(schema, [np.arange(classes), totals])

    got = counted.select("word").mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    sizes = np.zeros(classes)
    for r in got:
        sizes[r["c"]] = r["n"]
    return sizes
