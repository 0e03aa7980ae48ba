"""URL filtering: rules first, then gradient-boosted trees on lexical features.

A rule names a host and a path prefix and fits the host and its subdomains; of
the fitting rules the longest decides. URLs that no rule fits are judged by trees
over length, depth, digit ratio, entropy, parameter counts and statistics of the
host's suffixes. The labelled URLs to learn from are those that rules decide,
unless others are given: the statistics count all of them, the trees are fitted on
a sample.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Booster
from .session import hashed_sample, materialize, unused

SAMPLE = 5000
LEVELS = 3
_COUNTS = "_geolattice_counts"


@dataclass(frozen=True)
class Rule:
    """``host`` with its subdomains and a path prefix (with its slash); ``verdict`` is allow or block."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, both null if none does; of equal length the first given."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):  # the last one that fits stays
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _suffixes(host: Column) -> Column:
    """The last one, two and three labels of a host; null where it has fewer."""
    labels = F.split(host, r"\.")
    return F.array(*[F.when(F.size(labels) >= k, F.array_join(F.slice(labels, -k, k), ".")) for k in range(1, LEVELS + 1)])


def suffix_counts(known: DataFrame) -> DataFrame:
    """(suffix, n, bad): URLs and blocked URLs by host suffix, over all rows of (host, bad)."""
    hosts = known.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    each = hosts.select(F.explode(_suffixes(F.col("host"))).alias("suffix"), "n", "bad").where("suffix is not null")
    return each.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def host_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, counts: n and bad of each of its suffixes, shortest first) of the hosts of ``rows`` that have any."""
    asked = rows.select("host").distinct().select("host", F.posexplode(_suffixes(F.col("host"))).alias("level", "suffix")).where("suffix is not null")
    of = [F.coalesce(F.sum(F.when(F.col("level") == k, F.col(c))), F.lit(0)) for k in range(LEVELS) for c in ("n", "bad")]
    return asked.join(counts, "suffix").groupBy("host").agg(F.array(*of).alias(_COUNTS))


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


@dataclass
class Model:
    """Share of blocked URLs among all labelled ones, and the trees. One that has not seen both verdicts gives every URL 0."""

    share: float = 0.0
    booster: Booster = field(default_factory=Booster)
    learned: bool = False

    def features(self, url: str | None, host: str, path: str, counts: Sequence[int] | None, own: int | None = None) -> list[float]:
        """``counts``: of the host's suffixes, as in ``host_counts``; none for a host never seen. ``own``: the row's label, left out of them while learning."""
        url = url or ""
        query = url.partition("?")[2].partition("#")[0]
        segments = [s for s in path.split("/") if s]
        shares = []
        for k in range(LEVELS):
            n, bad = (0, 0) if counts is None else (int(counts[2 * k]), int(counts[2 * k + 1]))
            if own is not None and n:
                n, bad = n - 1, bad - own
            shares.append((bad + 4 * self.share) / (n + 4))
        digits = sum(c.isdigit() for c in url)
        return [
            float(len(url)),
            float(len(host)),
            float(len(path)),
            float(len(segments)),
            float(host.count(".")),
            float(host.count("-")),
            digits / max(1, len(url)),
            sum(c.isdigit() for c in host) / max(1, len(host)),
            _entropy(url),
            _entropy(host),
            float(len([p for p in query.split("&") if p])),
            float(len(query)),
            float("#" in url),
            float(url.startswith("https:")),
            float(max(map(len, segments), default=0)),
            *shares,
        ]


def learn(rows: Sequence[tuple[str, str, str, int, Sequence[int] | None]], share: float) -> Model:
    """From (url, host, path, 1 if blocked, counts of the host's suffixes) and the share of blocked URLs."""
    y = np.array([r[3] for r in rows], np.int64)
    model = Model(share)
    # Half of the rows go without statistics, so that the trees can judge hosts never seen.
    x = np.array([model.features(u, h, p, c if k % 2 else None, label) for k, (u, h, p, label, c) in enumerate(rows)]) if rows else np.zeros((0, 1))
    model.learned = len(y) > 0 and y.min() < y.max()
    model.booster = Booster(rounds=40, leaves=8, rate=0.2, least=10).fit(x, y)
    return model


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[Model, DataFrame]:
    """The model and the suffix counts of ``labelled`` (url, host, path, verdict). Null urls and verdicts are left out.

    Counts are over all rows; the trees learn from the first ``sample`` rows by hash of the url.
    """
    known = labelled.where("url is not null and verdict is not null").select("url", "host", "path", F.expr("int(verdict = 'block')").alias("bad"))
    counts = materialize(suffix_counts(known), "suffixes")
    n, bad = known.agg(F.count("*"), F.sum("bad")).first()
    rows = hashed_sample(known, F.col("url"), sample, n).orderBy(F.xxhash64("url"), "url", "bad").limit(sample).collect()  # a bounded sample
    hosts = known.sparkSession.createDataFrame([(h,) for h in sorted({r["host"] for r in rows})], "host string")
    of = {r["host"]: r[_COUNTS] for r in host_counts(hosts, counts).collect()}  # as many as the sample has hosts
    return learn([(*r, of.get(r["host"])) for r in rows], bad / n if n else 0.0), counts


def filter_urls(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """``pages`` with host, path, rule, verdict and ``score`` (0 to 1, higher: block; null where a rule decides).

    A null, empty or malformed url has an empty host and path; no rule fits it
    unless its host and path are empty, and the trees judge it. If the labelled
    URLs are not of both verdicts, there is nothing to learn: what no rule decides
    is allowed, with score 0. Columns of these names, in any case, are replaced,
    all others pass. Rows are judged one by one, repeated ones alike.
    """
    names = ("host", "path", "rule", "verdict", "score")
    host, path = host_and_path(F.col("url"))
    judged = pages.drop(*names).withColumn("host", host).withColumn("path", path)
    text, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", text).withColumn("verdict", verdict)
    if labelled is None:
        source = judged
    else:
        source = labelled.select("url", "verdict", host.alias("host"), path.alias("path"))
    model, counts = fit(source, sample)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # of bounded size
    hosts = materialize(host_counts(judged.where("rule is null"), counts), "hosts")  # of known size, so that few hosts go to all tasks

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = shared.value
        for url, host, path, rule, counts in batches:
            out = np.full(len(url), np.nan)
            free = np.flatnonzero(rule.isna())
            out[free] = 0.0
            if len(free) and own.learned:
                x = np.array([own.features(url.iloc[i], host.iloc[i], path.iloc[i], counts.iloc[i]) for i in free])
                out[free] = 1 / (1 + np.exp(-own.booster.log_odds(x)))
            yield pd.Series(out)

    held = unused(judged, _COUNTS)
    joined = judged.join(hosts.withColumnRenamed(_COUNTS, held), "host", "left").select(*judged.columns, held)
    asked = [F.when(F.col("rule").isNull(), F.col(c)) for c in ("url", "host", "path", held)]  # what a rule decides does not travel
    out = joined.withColumn("score", F.nanvl(score(*asked[:3], "rule", asked[3]), F.lit(None))).drop(held)
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
