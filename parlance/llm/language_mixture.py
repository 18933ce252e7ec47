"""Languages of a document as a mixture, fitted by expectation-maximisation.

Each language has a distribution over letter trigrams. A document's trigrams are a mixture of the
languages; its proportions are fitted by EM, and the set of languages is the one whose likelihood,
less a penalty for each language, is best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_rows, forget

#: Trigrams are numbered by a hash into so many features.
FEATURES = 1 << 15
#: Added to every count of a feature.
SMOOTHING = 0.5
#: Log-likelihood a trigram by which the background must win before a text counts as of no learned language.
MARGIN = 2.0
#: Log-likelihood that one more language must gain, for each unit of log(trigrams).
PENALTY = 2.0
ROUNDS, CLOSE = 40, 1e-3
UNKNOWN = "und"

_LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigram_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of the trigrams of lower-cased letters; every run of other characters is one space."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _LETTERS[points]
    points = np.where(letters, points, 32)
    points = points[np.concatenate(([True], letters[1:] | letters[:-1]))].astype(np.uint32)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    mixed = points[:-2] * np.uint32(2654435761) + points[1:-1] * np.uint32(2246822519) + points[2:] * np.uint32(3266489917)
    numbers = np.sort(((mixed ^ (mixed >> np.uint32(15))) % np.uint32(FEATURES)).astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1])))
    return numbers[first].astype(np.int64), np.diff(np.append(first, len(numbers))).astype(float)


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and per language the probability of each feature, from (text, lang) rows.

    All rows with a text and a language count. What reaches the driver is languages x FEATURES numbers.
    """
    schema = pa.schema([("lang", pa.string()), ("feature", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                numbers, counts = trigram_features(text.as_py())
                totals.setdefault(lang.as_py(), np.zeros(FEATURES, np.int64))[numbers] += counts.astype(np.int64)
        for lang, total in totals.items():
            found = np.flatnonzero(total)
            yield arrow_rows(schema, [[lang] * len(found), found, total[found]])

    known = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    summed = (
        known.select(F.col("lang").cast("string"), F.col("text").cast("string"))
        .mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    )
    table = summed.toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    counts = np.zeros((len(langs), FEATURES))
    if langs:
        rows = np.searchsorted(langs, table["lang"].to_pylist())
        counts[rows, table["feature"].to_numpy()] = table["n"].to_numpy()
    counts += SMOOTHING
    return langs, counts / counts.sum(axis=1, keepdims=True)


def _fit(like: np.ndarray, counts: np.ndarray, members: list[int]) -> tuple[float, np.ndarray]:
    """Log-likelihood and proportions of a mixture of some languages; like: feature x language."""
    if len(members) == 1:
        return float(counts @ np.log(like[:, members[0]])), np.ones(1)
    own, total = like[:, members], counts.sum()
    share = np.full(len(members), 1 / len(members))
    for _ in range(ROUNDS):
        new = share * (own.T @ (counts / (own @ share))) / total
        done = np.abs(new - share).max() < CLOSE
        share = new
        if done:
            break
    return float(counts @ np.log(own @ share)), share


def mixture(text: str | None, langs: list[str], model: np.ndarray) -> dict[str, float]:
    """Proportions of the languages a text is written in; empty without letters or learned languages.

    Languages join one at a time, the one that gains most likelihood first, while the gain exceeds
    the penalty; of equal ones the first by name.
    """
    numbers, counts = trigram_features(text or "")
    if not len(numbers) or not langs:
        return {}
    like = model[:, numbers].T
    alone = counts @ np.log(like)
    chosen = [int(np.argmax(alone))]
    best, share = float(alone[chosen[0]]), np.ones(1)
    price = PENALTY * np.log(counts.sum() + 1)
    # No mixture of all languages can be beaten by a smaller one, so most texts are settled here.
    if len(langs) > 1 and _fit(like, counts, list(range(len(langs))))[0] - best > price:
        while len(chosen) < len(langs):
            trials = [(*_fit(like, counts, [*chosen, k]), k) for k in range(len(langs)) if k not in chosen]
            gained, shares, k = max(trials, key=lambda t: t[0])
            if gained - best <= price:
                break
            best, share, chosen = gained, shares, [*chosen, k]
    return {langs[k]: float(s) for k, s in zip(chosen, share)}


def language_columns(spark, langs: list[str], model: np.ndarray):
    """A function of a text column that gives struct(lang_pred, score, mixture) of every row.

    lang_pred: the language of the largest proportion, `und` for a text that is null or has no
    letter; score: that proportion, 0 for `und`; mixture: language to proportion.
    """
    shared = spark.sparkContext.broadcast((langs, model.astype(np.float32)))

    @F.pandas_udf("lang_pred string, score double, mixture map<string, double>")
    def judge(text: pd.Series) -> pd.DataFrame:
        names, table = shared.value
        found = [mixture(t, names, table) for t in text]
        top = [max(m.items(), key=lambda x: x[1]) if m else (UNKNOWN, 0.0) for m in found]
        return pd.DataFrame(
            {"lang_pred": [t[0] for t in top], "score": [min(1.0, t[1]) for t in top], "mixture": found}
        )

    def columns(text: Column) -> Column:
        return judge(text.cast("string"))

    return columns


def gain(text: str | None, langs: list[str], model: np.ndarray) -> float | None:
    """What a text's mixture of languages explains better than a background in which all trigrams are as likely.

    The difference of the log-likelihoods for each trigram; None without letters or learned languages.
    """
    found = mixture(text, langs, model)
    if not found:
        return None
    numbers, counts = trigram_features(text or "")
    like = model[[langs.index(lang) for lang in found]][:, numbers].T @ np.array(list(found.values()))
    return float(counts @ np.log(like) / counts.sum() + np.log(FEATURES))


def known_language(spark, langs: list[str], model: np.ndarray):
    """A function of a text column: whether the background explains the text no better than its mixture by more than MARGIN.

    False for a null text and one without letters; true for all texts where nothing could be learnt.
    Trigrams never seen cost more the more was learnt, so little training text keeps nearly all texts with letters.
    """
    shared = spark.sparkContext.broadcast((langs, model.astype(np.float32)))

    @F.pandas_udf("boolean")
    def judge(text: pd.Series) -> pd.Series:
        forget()
        names, table = shared.value
        found = (gain(t, names, table) for t in text)
        return pd.Series([not names or (g is not None and g > -MARGIN) for g in found], index=text.index, dtype="bool")

    return lambda text: judge(text.cast("string"))


def predict_languages(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score, mixture of every row of `docs`, learnt from `training` (text, lang).

    A null text, or one without a letter, is `und` with score 0, as is every text where nothing could
    be learnt. Texts of any length count whole; repeated rows are judged alike; an empty table gives
    an empty one. Of `docs` only doc_id and text are read.
    """
    judge = language_columns(docs.sparkSession, *learn(training))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), judge(F.col("text")).alias("judged"))
    return slim.select("doc_id", "judged.lang_pred", "judged.score", "judged.mixture")
