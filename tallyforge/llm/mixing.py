"""Mixing to target weights by soft domain membership.

A classifier learned from the labelled table gives each document a posterior
over domains (good, toxic, low quality). Its words' evidence is naive Bayes on a
bounded vocabulary, the words most telling between domains, and on bins of a few
rates. The rates r of documents, all >= 0, are fitted so that the expected tokens
of each domain, the sum over documents of r * words * posterior, meet the targets
in least squares, plus RIDGE times the squared distance of rates from one, which
chooses among the many rates that meet them and keeps those of targets out of
reach finite. Gradient steps add up from a rate of one on, and the sum is cut at
zero (a projected gradient with lazy projection), so a rate is one minus the
posterior times one vector, cut at zero. Steps are scaled by the Gram matrix of
the documents whose rate is above zero; each pass tries a few lengths and takes
the best. It ends when the projected gradient is zero, or says how far it got. A
document is then repeated floor(r + u) times, u being its own fixed uniform
number.

Work over documents is in DataFrame functions: each step is one aggregation of
a written table of one narrow row per document; the driver holds numbers per
domain and the vocabulary.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

DOMAINS = ("good", "toxic", "low")
#: Share of the tokens that each domain is to have; the total is kept.
TARGETS = {"good": 0.96, "toxic": 0.02, "low": 0.02}
#: Labelled documents read to learn from, by hash order; words of the
#: vocabulary; least documents with a word and least log-likelihood ratio.
SAMPLE, VOCABULARY, LEAST, TELLING = 4000, 256, 5, 14.0
#: Weight of the distance of rates from one; passes at most; projected gradient
#: (a share of all tokens) to stop at; lengths of a step; gap that is reported.
RIDGE, STEPS, TOLERANCE, LENGTHS, REPORTED = 1e-6, 40, 1e-6, (1.0, 0.3, 0.1, 0.02), 0.01
RATES = {"repeat": (0.02, 0.1, 0.3, 0.6), "symbol": (0.002, 0.02, 0.1), "upper": (0.1, 0.25, 0.5), "mark": (0.02, 0.2, 0.5)}
SPACE = r"[ \t-\r]+"


def _measured(docs: DataFrame, vocabulary: list[str] | None) -> DataFrame:
    """docs (text) with n_tokens (words between white space), bins and hits
    (words of the vocabulary that occur), or the distinct words w_ if there is
    no vocabulary yet. The vocabulary's words are runs of letters in lower case."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumns({"bare_": F.split(F.lower(text), r"[^\p{L}]+"), "n_tokens": F.size(F.array_remove(F.split(text, SPACE), "")).cast("long")})
    df = df.withColumn("set_", F.array_distinct("bare_"))
    n, words = F.greatest(F.length(text), F.lit(1)), F.size("bare_")
    cut = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / n
    # Short texts repeat little by nature: below 40 words the rate shrinks in proportion.
    rates = {
        "repeat": (words - F.size("set_")) / F.greatest(words, F.lit(40)), "symbol": cut(r"[#*$%&|<>]+"), "upper": cut("[A-Z]+"),
        "mark": cut("[!?]+") * n / F.greatest(F.col("n_tokens"), F.lit(1)),
    }
    bins = [sum((F.when(rates[k] > e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int").alias(k) for k, edges in RATES.items()]
    if vocabulary is None:
        return df.select("*", F.array(*bins).alias("bins"), F.col("set_").alias("w_")).drop("bare_", "set_")
    hits = F.array_intersect("set_", F.lit(vocabulary)) if vocabulary else F.lit([]).cast("array<string>")
    return df.select("*", F.array(*bins).alias("bins"), hits.alias("hits")).drop("bare_", "set_")


def domain() -> Column:
    return F.when(F.col("quality") == 0, 2).when(F.col("toxic") == 1, 1).otherwise(0)


class Evidence:
    """Log-odds of each domain: a prior, weights by bin and by word."""

    def __init__(self, prior: list[float], bins: list[list[list[float]]], words: dict[str, list[float]]):
        self.prior, self.bins, self.words = prior, bins, words

    def posterior(self) -> list[Column]:
        keys = list(self.words)
        logs = []
        for d in range(len(DOMAINS)):
            by_bin = sum((F.element_at(F.lit([b[d] for b in table]), F.get("bins", F.lit(i)) + 1) for i, table in enumerate(self.bins)), F.lit(self.prior[d]))
            if keys:
                table = F.map_from_arrays(F.lit(keys), F.lit([self.words[k][d] for k in keys]))
                by_bin = by_bin + F.aggregate("hits", F.lit(0.0), lambda s, w: s + F.element_at(table, w))
            logs.append(by_bin)
        return logs


def learned(docs: DataFrame, labels: DataFrame) -> Evidence:
    """From at most SAMPLE labelled documents. Without labels, all are
    'good'. Rows with a null label are not used."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain().alias("d"), "quality").where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.max("d").alias("d")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = written(_measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id"), None).select("d", "bins", "w_"), "mixing-sample")
    sizes = {r["d"]: r["count"] for r in rows.groupBy("d").count().collect()}
    k = len(DOMAINS)
    n = [sizes.get(d, 0) for d in range(k)]
    total = sum(n)
    prior = [math.log((n[d] + 0.5) / (total + 0.5 * k)) for d in range(k)] if total else [0.0, -30.0, -30.0]
    counts = {(r["f"], r["b"], r["d"]): r["count"] for r in rows.select("d", F.posexplode("bins").alias("f", "b")).groupBy("f", "b", "d").count().collect()}
    bins = []
    for i, edges in enumerate(RATES.values()):
        size = len(edges) + 1
        bins.append([[math.log((counts.get((i, b, d), 0) + 0.5) / (n[d] + 0.5 * size)) for d in range(k)] for b in range(size)])
    # A word tells as much as its counts by domain differ from chance (likelihood ratio).
    per = [F.count_if(F.col("d") == d).alias(f"c{d}") for d in range(k)]
    words = rows.select("d", F.explode("w_").alias("w")).where("w <> ''").groupBy("w").agg(*per, F.count("*").alias("c")).where(F.col("c") >= LEAST)
    ratio = sum((F.when(F.col(f"c{d}") > 0, F.col(f"c{d}") * F.log(F.col(f"c{d}") * float(max(total, 1)) / (F.col("c") * float(max(n[d], 1))))).otherwise(0.0) for d in range(k)), F.lit(0.0))
    best = words.withColumn("g", F.round(ratio, 6)).where(F.col("g") >= TELLING).orderBy(F.desc("g"), "w").limit(VOCABULARY).collect()
    weights = {}
    for r in best:
        # Absence counts as evidence too: it goes to the prior, presence gets the odds.
        p = [(r[f"c{d}"] + 0.5) / (n[d] + 1) for d in range(k)]
        prior = [a + math.log1p(-x) for a, x in zip(prior, p, strict=True)]
        weights[r["w"]] = [math.log(x) - math.log1p(-x) for x in p]
    return Evidence(prior, bins, weights)


def memberships(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with n_tokens, u_ (uniform()) and p_<domain>, the posteriors (they
    sum to 1)."""
    evidence = learned(docs, labels)
    rows = _measured(docs.withColumn("u_", uniform()), list(evidence.words)).withColumn("logs_", F.array(*evidence.posterior()))
    rows = rows.withColumn("top_", F.array_max("logs_")).withColumn("e_", F.transform("logs_", lambda x: F.exp(x - F.col("top_"))))
    total = F.aggregate("e_", F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("sum_", total)
    return rows.select("*", *[(F.get("e_", F.lit(d)) / F.col("sum_")).alias(f"p_{name}") for d, name in enumerate(DOMAINS)]).drop("bins", "hits", "logs_", "top_", "e_", "sum_")


def fitted(rows: DataFrame, targets: dict[str, float]) -> tuple[list[float], dict[str, float]]:
    """The vector (by domain) that all rates follow from, and the tokens
    reached. rows: n_tokens and p_<domain>. One aggregation a pass."""
    names = [f"p_{d}" for d in DOMAINS]
    k = range(len(names))
    want = [targets[d] for d in DOMAINS]
    pull, total = [0.0] * len(names), 0.0
    tried, length, best = [pull], 1.0, None
    for _ in range(STEPS):
        sums = [F.sum("n_tokens").alias("n")]
        for c, x in enumerate(tried):
            r, live = F.col(f"r{c}"), F.when(F.col(f"r{c}") > 0, F.col("n_tokens")).otherwise(0)
            sums += [F.sum(F.col("n_tokens") * r * r).alias(f"s{c}"), *[F.sum(F.col("n_tokens") * r * F.col(p)).alias(f"g{c}_{i}") for i, p in enumerate(names)]]
            sums += [F.sum(live * F.col(names[i]) * F.col(names[j])).alias(f"m{c}_{i}{j}") for i in k for j in k if i <= j]
        got = rows.select("*", *[rate(x).alias(f"r{c}") for c, x in enumerate(tried)]).agg(*sums).first()
        if not (total := float(got["n"] or 0)):
            return pull, {d: 0.0 for d in DOMAINS}
        found = []
        for c, x in enumerate(tried):
            reached = [got[f"g{c}_{i}"] / total for i in k]
            value = got[f"s{c}"] / total / 2 + sum(a * b for a, b in zip(want, x)) + RIDGE / 2 * sum(a * a for a in x)
            gram = {(i, j): got[f"m{c}_{min(i, j)}{max(i, j)}"] / total for i in k for j in k}
            found.append((value, x, reached, gram))
        new = min(found, key=lambda f: f[0])
        if best is None or new[0] < best[0]:
            best, length = new, 1.0
        elif length < 1e-6:
            break  # no step is better any more
        else:
            length *= LENGTHS[-1]
        _, pull, reached, gram = best
        gradient = [a - b - RIDGE * c for a, b, c in zip(reached, want, pull)]
        if max(map(abs, gradient)) < TOLERANCE:
            break
        step = solved(gram, gradient)
        tried = [[a + length * f * b for a, b in zip(pull, step)] for f in LENGTHS]
    _, pull, reached, _ = best
    return pull, {d: v * total for d, v in zip(DOMAINS, reached)}


def solved(gram: dict, gap: list[float]) -> list[float]:
    """Gaussian elimination on the few domains."""
    k = len(gap)
    a = [[gram[i, j] + (RIDGE if i == j else 0.0) for j in range(k)] + [gap[i]] for i in range(k)]
    for i in range(k):
        p = max(range(i, k), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        for r in range(k):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i], strict=True)]
    return [a[i][k] / a[i][i] for i in range(k)]


def rate(pull: list[float]) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(f"p_{name}") * v for name, v in zip(DOMAINS, pull, strict=True)), F.lit(0.0)))


def uniform() -> Column:
    """A fixed number in [0, 1) per document."""
    return F.pmod(F.xxhash64(F.lit("mixing"), F.col("doc_id").cast("long"), F.col("text")), F.lit(1 << 20)) / float(1 << 20)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of docs (all, if not said) with n_tokens, p_<domain>, rate (>= 0) and copies per row.

    Expected tokens by domain meet the targets' shares of all tokens as closely
    as rates can; where a share misses its target by more than REPORTED a
    warning says so. Texts without words have no tokens, hence no say, and their
    rate follows from their posterior. Rows of equal posteriors have equal
    rates, repeated rows equal copies. An empty table has no rows; texts may be
    of any length. Columns of these names are replaced."""
    targets = targets or TARGETS
    new = {"n_tokens", "rate", "copies", *(f"p_{d}" for d in DOMAINS)}
    carry = [c for c in carry or docs.columns if c.lower() not in new]
    # What is carried goes in one struct, so no name in it can clash with one in use here.
    own = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("own_")
    members = memberships(docs.select("doc_id", "text", own), labels)
    rows = written(members.select("own_", "n_tokens", "u_", *[f"p_{d}" for d in DOMAINS]), "mixing-members")
    pull, reached = fitted(rows.select("n_tokens", *[f"p_{d}" for d in DOMAINS]), targets)
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    if total and max(abs(reached[d] / total - targets[d]) for d in DOMAINS) > REPORTED:
        warnings.warn(f"mixing reaches {', '.join(f'{d} {v / total:.4f}' for d, v in reached.items())} of {targets}", stacklevel=2)
    copies = F.floor(F.col("rate") + F.col("u_")).cast("int").alias("copies")
    return rows.withColumn("rate", rate(pull)).select("own_.*", "n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", copies)


def repeated(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as its copies say."""
    return rows.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), "copies")).alias("copy_")).select(*columns)
