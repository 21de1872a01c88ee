"""URL filters: host rules, and a character language-model ratio for the rest.

Two variable-order Markov models over folded characters, one of accepted and one of
rejected urls, are smoothed from order to order (Witten-Bell).  A url that no rule decides
is judged by the difference of its two log-likelihoods per character, against a threshold
calibrated on a held-out fifth of the decided urls.  All steps are DataFrame operations.

Characters are folded to 32 symbols and contexts have at most three, so the models hold at
most 32^4 rows, however large the corpus: they may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durable import durable

ALLOW, BLOCK = "allow", "block"
ORDER = 4  # symbols of a gram: three of context and one that follows
SYMBOLS = 32
BIN = 0.01  # width of a threshold's step
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host with A-Z lower-cased, and the path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]], result: int = 0) -> Column:
    """The longest rule that fits host and path (``result`` 1: its verdict), else null.

    A rule ``host/path`` fits its host and all subdomains where the path begins with its own.
    """

    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        under = (host == name) | host.endswith(f".{name}")
        return under & path.startswith(slash + rest)

    longest = sorted(rules, key=lambda rule: (-len(rule[0]), rule))
    return F.coalesce(*[F.when(fits(rule[0]), F.lit(rule[result])) for rule in longest], F.lit(None).cast("string"))


def folded(url: Column) -> Column:
    """Lower-case letters, 0 for any digit, / . and -, ? for any other character."""
    digits = F.translate(F.lower(url), "123456789", "000000000")
    return F.regexp_replace(digits, r"[^a-z0/.\-]", "?")


def exploded_grams(urls: DataFrame) -> DataFrame:
    """One row per character of ``url``: it and the three before it, ``^`` where there are none."""
    start = "^" * (ORDER - 1)
    padded = urls.withColumn("padded", F.concat(F.lit(start), folded(F.col("url")))).where(F.length("url") > 0)
    places = F.sequence(F.lit(1), F.length("padded") - len(start))
    grams = F.transform(places, lambda i: F.col("padded").substr(i, F.lit(ORDER)))
    return padded.select("*", F.explode(grams).alias("gram")).drop("padded")


def log_ratios(grams: DataFrame) -> DataFrame:
    """(gram, log_ratio) of accepted to rejected probability, from (gram, accepted, rejected) counts.

    P_k(c | h) = (n(hc) + T(h) P_k-1(c | h')) / (n(h) + T(h)), with T(h) the number of different
    symbols seen after h and h' the context without its first symbol; P_0 is uniform.
    """
    sides = ("accepted", "rejected")
    lower = None
    for k in range(1, ORDER + 1):
        counts = grams.groupBy(F.substring("gram", -k, k).alias("gram")).agg(*[F.sum(s).alias(s) for s in sides])
        counts = counts.withColumn("context", F.substring("gram", 1, k - 1))
        contexts = counts.groupBy("context").agg(
            *[F.sum(s).alias(f"n_{s}") for s in sides], *[F.count_if(F.col(s) > 0).alias(f"t_{s}") for s in sides]
        )
        rows = counts.join(F.broadcast(contexts), "context")
        if lower is None:
            rows = rows.withColumns({f"p_{s}": F.lit(1 / SYMBOLS) for s in sides})
        else:
            rows = rows.withColumn("shorter", F.substring("gram", 2, k - 1)).join(F.broadcast(lower), "shorter")
        smooth = {
            s: F.when(
                F.col(f"n_{s}") > 0,
                (F.col(s) + F.col(f"t_{s}") * F.col(f"p_{s}")) / (F.col(f"n_{s}") + F.col(f"t_{s}")),
            ).otherwise(F.col(f"p_{s}"))
            for s in sides
        }
        name = "gram" if k == ORDER else "shorter"
        lower = rows.select(F.col("gram").alias(name), *[smooth[s].alias(f"p_{s}") for s in sides])
    return lower.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("log_ratio"))


def calibrated(scored: DataFrame) -> float:
    """The step that separates accepted from rejected urls of (score, verdict, n) best.

    Least mean of the two error shares; of equal steps the one nearest 0.  Without urls
    of both kinds it is 0.
    """
    bins = scored.groupBy(F.round(F.col("score") / BIN).alias("bin")).agg(
        *[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in (ALLOW, BLOCK)]
    )
    # Scores are mean log ratios of smoothed probabilities: a few thousand bins at most.
    rows = sorted(tuple(row) for row in bins.collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    best, lost, caught = None, 0, 0
    for at, allowed, blocked in rows:  # threshold in front of this bin
        error = lost / good + 1 - caught / bad
        if best is None or (error, abs(at)) < best[:2]:
            best = (error, abs(at), at)
        lost, caught = lost + allowed, caught + blocked
    return (best[2] - 0.5) * BIN


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score``, one row per row.

    A null or empty url has no characters and the score 0.  Equal urls get equal verdicts;
    a url of any length is scored whole; columns of ``pages`` that have the names of the
    new ones are replaced; an empty table gives an empty result.  Without decided urls all
    scores are 0 and the rest is allowed.
    """
    new = ("host", "path", "rule", "verdict", "score")
    host, path = host_and_path(F.col(url))
    known = (
        pages.select(F.col(url).alias("url"))
        .where(F.col("url").isNotNull())
        .groupBy("url")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    own_host, own_path = host_and_path(F.col("url"))
    known = known.withColumn("verdict", matching_rule(own_host, own_path, rules, 1))
    known = durable(known.withColumn("learn", F.pmod(F.crc32("url"), F.lit(5)) != 0))

    def seen(verdict: str) -> Column:
        return F.sum(F.when((F.col("verdict") == verdict) & F.col("learn"), F.col("n")).otherwise(0))

    rows = exploded_grams(known)
    grams = durable(rows.groupBy("gram").agg(seen(ALLOW).alias("accepted"), seen(BLOCK).alias("rejected")))
    model = durable(log_ratios(grams))
    scores = (
        exploded_grams(known.select("url"))
        .join(F.broadcast(model), "gram")
        .groupBy("url")
        .agg((F.sum("log_ratio") / F.count(F.lit(1))).alias("score"))
    )
    scored = durable(known.join(scores, "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0))))
    threshold = calibrated(scored.where(F.col("verdict").isNotNull() & ~F.col("learn")))

    keep = [c for c in pages.columns if c not in new]
    joined = pages.select(keep).join(scored.select(F.col("url").alias("_url"), "score"), F.col(url) == F.col("_url"), "left")
    judged = joined.withColumn("score", F.coalesce("score", F.lit(0.0))).drop("_url")
    decided = judged.withColumns({"host": host, "path": path}).withColumns(
        {
            "rule": matching_rule(F.col("host"), F.col("path"), rules),
            "_ruled": matching_rule(F.col("host"), F.col("path"), rules, 1),
        }
    )
    by_model = F.when(F.col("score") >= threshold, ALLOW).otherwise(BLOCK)
    return decided.withColumn("verdict", F.coalesce("_ruled", by_model)).select(
        *keep, "host", "path", "rule", "verdict", "score"
    )
