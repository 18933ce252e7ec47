"""URL filter: stated rules, and a likelihood ratio of two character models for the rest.

The rules judge some addresses; those are the examples from which one Markov model of accepted and one
of rejected addresses are counted. Each mixes contexts of up to three characters, longest known first
(Witten-Bell weights). An address that no rule fits is judged by the mean log-likelihood difference a
character, against a threshold calibrated on rule-judged addresses that the models have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters the models tell apart; all others count as `?`. `^` pads the start, `$` ends an address.
KNOWN = LOWER + "0123456789./_-"
ALPHABET = len(KNOWN) + 2
ORDER = 3
#: A context is used from this many occurrences on.
LEAST = 2
#: Log ratios are whole millionths of a nat, so that sums do not depend on their order.
UNIT = 1_000_000
#: At most this many distinct grams are sent to all executors; more of them are joined by a shuffle.
BROADCAST_GRAMS = 300_000


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(line: str) -> Rule:
    """`allow example.org/es/`: the verdict, then host and path."""
    verdict, address = line.split()
    host, slash, path = address.partition("/")
    return Rule(verdict, host, slash + path)


def address(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _grams(docs: DataFrame) -> DataFrame:
    """address, label, held and one row for each character with its ORDER characters before it."""
    padded = F.concat(F.lit("^" * ORDER), F.col("plain"), F.lit("$"))
    cells = docs.withColumn("c", F.split(padded, ""))
    windows = F.transform(
        F.sequence(F.lit(0), F.length("plain")),
        lambda i: F.concat(*(F.get("c", i + k) for k in range(ORDER + 1))),
    )
    return cells.select("address", "label", "held", F.explode(windows).alias("gram"))


def _models(examples: DataFrame, asked: DataFrame) -> DataFrame:
    """gram, ratio: the log-likelihood difference of every asked gram's last character.

    All tables here are bounded by the alphabet: at most ALPHABET ** (ORDER + 1) grams.
    """
    counts = examples.groupBy("gram").agg(
        F.sum(F.when(F.col("label") == "allow", 1).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("label") == "block", 1).otherwise(0)).alias("b"),
    )
    out = asked.withColumns({"p_a": F.lit(1.0 / ALPHABET), "p_b": F.lit(1.0 / ALPHABET)})
    for j in range(1, ORDER + 2):
        grams = counts.groupBy(F.right("gram", F.lit(j)).alias("g")).agg(F.sum("a").alias("c_a"), F.sum("b").alias("c_b"))
        contexts = grams.groupBy(F.left("g", F.lit(j - 1)).alias("x")).agg(
            F.sum("c_a").alias("n_a"),
            F.sum("c_b").alias("n_b"),
            F.sum(F.signum("c_a")).alias("t_a"),
            F.sum(F.signum("c_b")).alias("t_b"),
        )
        out = out.join(grams, F.right("gram", F.lit(j)) == F.col("g"), "left")
        out = out.join(contexts, F.substring("gram", ORDER + 2 - j, j - 1) == F.col("x"), "left")
        mixed = {}
        for k in "ab":
            n, t, p = F.col(f"n_{k}"), F.col(f"t_{k}"), F.col(f"p_{k}")
            seen = (F.coalesce(F.col(f"c_{k}"), F.lit(0)) + t * p) / (n + t)
            mixed[f"p_{k}"] = F.when(n >= LEAST, seen).otherwise(p)
        out = out.withColumns(mixed).select("gram", "p_a", "p_b")
    return out.select("gram", F.round((F.log("p_a") - F.log("p_b")) * UNIT).cast("long").alias("ratio"))


def _threshold(scored: DataFrame) -> int:
    """The cut, in hundredths of a nat a character, that errs least on both classes of held-out addresses.

    Errors are shares of their class; of equal cuts the one nearest to zero counts. Zero where a class
    is missing. Only counts by hundredths reach the driver, for scores bounded by the models.
    """
    held = scored.filter(F.col("held") & F.col("label").isNotNull())
    bins = held.groupBy(F.floor(F.col("total") * 100 / (F.col("length") * UNIT)).alias("bin")).agg(
        F.sum(F.when(F.col("label") == "allow", 1).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("label") == "block", 1).otherwise(0)).alias("b"),
    )
    rows = sorted((r["bin"], r["a"], r["b"]) for r in bins.collect())
    n_a, n_b = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not n_a or not n_b:
        return 0
    best, below_a, below_b = (1.0, 0, 0), 0, 0
    for k, (cut, a, b) in enumerate([*rows, (rows[-1][0] + 1, 0, 0)]):
        error = below_a / n_a + (n_b - below_b) / n_b
        low = rows[k - 1][0] + 1 if k else cut
        near = min(max(0, low), cut)  # any cut between two filled bins parts them alike
        best = min(best, (error, abs(near), near))
        below_a, below_b = below_a + a, below_b + b
    return best[2]


def filter_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id") -> DataFrame:
    """Judge every URL: key, host, path, rule, verdict, score.

    The longest fitting rule decides (`rule`: its text, `verdict`: allow or block). Else `rule` is
    null and the models decide: allow where `score` (mean log-likelihood difference of host and path
    a character, in nats) reaches the threshold. Rule-judged addresses are the examples, each
    distinct address once; a fifth of them, by hash, only calibrates the threshold.

    A null URL or one without `://` has an empty host and path, which no rule with a host fits. Long
    addresses are scored whole. Repeated rows are judged alike, one row each; an empty table gives an
    empty one, and without examples of both classes the threshold is 0. Columns other than the key
    and `url` are not read. Native: Spark's own functions only.
    """
    host, path = address(F.col("url"))
    judged = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"))
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [
        ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        for r in ranked
    ]
    nothing = F.lit(None).cast("string")
    rule = F.coalesce(*(F.when(f, r.text) for f, r in zip(fits, ranked)), nothing)
    label = F.coalesce(*(F.when(f, r.verdict) for f, r in zip(fits, ranked)), nothing)
    plain = F.translate(F.concat("host", "path"), UPPER, LOWER)
    judged = judged.withColumns(
        {"rule": rule, "label": label, "plain": F.regexp_replace(plain, f"[^{KNOWN[:-1]}-]", "?")}
    ).withColumn("address", F.concat_ws(" ", "host", "path"))
    distinct = judged.groupBy("address").agg(F.first("plain").alias("plain"), F.first("label").alias("label"))
    distinct = distinct.withColumn("held", F.crc32(F.encode("address", "UTF-8")) % 5 == 0)
    grams = _grams(distinct)
    models = _models(grams.filter(F.col("label").isNotNull() & ~F.col("held")), grams.select("gram").distinct())
    # Stored, bounded by the alphabet: else each reader below plans and runs the joins of the models anew.
    models = stored(models, "url-models")
    if models.count() <= BROADCAST_GRAMS:
        models = F.broadcast(models)
    scored = grams.join(models, "gram").groupBy("address").agg(
        F.sum("ratio").alias("total"), F.count("*").alias("length"), F.first("label").alias("label"), F.first("held").alias("held")
    )
    cut = _threshold(scored)
    found = scored.select(
        F.col("address").alias("a"),
        (F.col("total") / (F.col("length") * UNIT)).alias("score"),
        (F.floor(F.col("total") * 100 / (F.col("length") * UNIT)) >= cut).alias("accepted"),
    )
    own = F.when(F.col("accepted"), "allow").otherwise("block")
    return judged.join(found, F.col("address") == F.col("a"), "left").select(
        key, "host", "path", "rule", F.coalesce("label", own).alias("verdict"), "score"
    )
