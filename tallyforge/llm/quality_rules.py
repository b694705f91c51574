"""Quality rules whose cutoffs carry a guarantee on false rejection.

Each rule rejects a document whose feature is above a cutoff. Strata are
languages; those with too few labelled good documents to prove anything are one
stratum together, to which languages without labels belong too (merged by their
number alone, which tells nothing of rejections). Labelled good documents are
split by a hash of doc_id (split fixed-sequence testing):

* on the smaller part each rule's strictest cutoff is found that rejects at most
  its share of half of EPSILON. Settings are these cutoffs, and the same a few
  notches looser;
* on the larger part, the holdout, settings are tested from the loosest to the
  strictest: one passes if, were the true rate at which its rules together
  reject good documents EPSILON, so few rejections or fewer would be seen with
  probability at most DELTA / strata, by the exact binomial tail (the
  Clopper-Pearson bound). Testing stops at the first that fails, which needs no
  further correction; the last that passed holds.

With probability 1 - DELTA, in every stratum the rules together reject at most
EPSILON of the good documents that pass the base rules. Where labels are too few
for any setting to pass, the base rules alone decide.

All work is in DataFrame functions. The driver gets the number of languages and
the one row of the joint stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, sized, written

EPSILON, DELTA = 0.03, 0.05
#: Settings tested: cutoffs this many notches looser than the strictest.
NOTCHES = (4, 3, 2, 1, 0)
#: Rows whose hash starts with a digit below this are for finding cutoffs: a quarter.
PICKED = "4"
#: A row of cutoffs in memory, at most.
STRATUM_BYTES = 256
#: feature: cutoffs from the loosest to the strictest.
CUTOFFS = {
    "symbol_rate": (0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01),
    "upper_rate": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "dup_line_rate": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "mark_rate": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
}
SPACE = r"[ \t-\r]+"


def _counted(df: DataFrame) -> DataFrame:
    """df (with text_, never null) plus n_words .. n_repeat_words, features."""
    df = df.withColumn("w_", F.filter(F.split("text_", SPACE), lambda x: x != ""))
    df = df.withColumn("n_words", F.size("w_").cast("long"))
    hashes = F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - 5),
        lambda i: F.xxhash64(*[F.get("w_", i + k) for k in range(5)]),
    )

    def covered(starts: Column) -> Column:
        """Positions in the five-word windows at the sorted starts."""
        more = F.zip_with(F.slice(starts, 2, F.size(starts)), F.slice(starts, 1, F.size(starts) - 1), lambda b, a: F.least(b - a, F.lit(5)))
        return F.when(F.size(starts) == 0, F.lit(0)).otherwise(5 + F.aggregate(more, F.lit(0), lambda s, x: s + x))

    def repeated(s: Column) -> Column:
        """Starts of the windows that equal a neighbour in sorted order."""
        same = lambda x, i: F.get(s, i)["s"] == x["s"]
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False))), lambda x: x["p"]))

    windows = F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - 5),
        lambda i: F.struct(F.array_join(F.slice("w_", i + 1, F.lit(5)), " ").alias("s"), i.alias("p")),
    )
    exact = bind(F.sort_array(windows), lambda s: bind(repeated(s), covered))
    # Windows with distinct hashes are distinct; only if hashes repeat are the windows themselves compared.
    maybe = bind(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    df = df.withColumn("maybe_", F.when(F.col("n_words") >= 6, maybe).otherwise(False))
    lines = F.filter(F.split("text_", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    df = df.withColumn("dups_", bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))))
    df = df.select(
        "*",
        F.length(F.array_join("w_", "")).cast("long").alias("word_chars"),
        (F.length("text_") - F.length(F.regexp_replace("text_", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.col("dups_.d").cast("long").alias("n_dup_lines"),
        F.when(F.col("maybe_"), exact).otherwise(0).cast("long").alias("n_repeat_words"),
        (F.length("text_") - F.length(F.regexp_replace("text_", "[A-Z]+", ""))).alias("upper_"),
        (F.length("text_") - F.length(F.regexp_replace("text_", "[!?]+", ""))).alias("marks_"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return df.select(
        "*",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        rate("n_symbols", "word_chars").alias("symbol_rate"),
        rate("upper_", "word_chars").alias("upper_rate"),
        rate("dups_.d", "dups_.n").alias("dup_line_rate"),
        rate("marks_", "n_words").alias("mark_rate"),
    ).drop("w_", "maybe_", "dups_", "upper_", "marks_")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """own_ (a struct of the carried columns, so that no name in it can clash),
    key_, the counts and features. A null text has no words, a null lang is ''."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    own = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("own_")
    return _counted(docs.select(own, F.col("doc_id").cast("long").alias("key_"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text_"), lang.alias("lang_")))


def tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed; stops once it is past 1/2."""
    total = 0.0
    for i in range(k + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
        if total > 0.5:
            break
    return total


def below(n: Column, k: Column, level: float) -> Column:
    """Whether tail(n, k, EPSILON) <= level, for a level below 1/2. The median
    is at least floor(n * EPSILON), so from there on it isn't, unsummed."""
    step = lambda i: F.log((n - i + 1) / i) + F.lit(math.log(EPSILON) - math.log1p(-EPSILON))
    first = n * F.lit(math.log1p(-EPSILON))
    start = F.struct(first.alias("term"), F.exp(first).alias("total"))

    def add(s: Column, i: Column) -> Column:
        return bind(s["term"] + step(i), lambda t: F.struct(t.alias("term"), (s["total"] + F.exp(t)).alias("total")))

    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), start, add)["total"]
    return F.when(k >= F.floor(n * F.lit(EPSILON)) + 1, False).otherwise(total <= level)


def picked() -> Column:
    return F.substring(F.md5(F.col("key_").cast("string").cast("binary")), 1, 1) < PICKED


def least(strata: int) -> int:
    """Holdout documents without which no setting can pass."""
    return math.ceil(math.log(DELTA / strata) / math.log1p(-EPSILON))


def cutoff_table(good: DataFrame) -> tuple[DataFrame, int]:
    """lang_, stratum_ (null: the joint one) and a column cut_<feature> each, null where the rule is off, for
    all labelled languages, and how many these are. good: key_, lang_ and the
    features of labelled good documents that the base rules pass."""
    # A struct for each (stratum, rule, cutoff) would be many rows; counts are summed in place instead.
    names = {f: [f"{f}:{i}" for i in range(len(cs))] for f, cs in CUTOFFS.items()}
    sums = [F.count_if(F.col("pick_") & (F.col(f) > c)).alias(n) for f, cs in CUTOFFS.items() for n, c in zip(names[f], cs, strict=True)]
    good = good.withColumn("pick_", picked())
    rows = written(good.groupBy("lang_").agg(F.count_if(~F.col("pick_")).alias("held"), F.count_if("pick_").alias("n"), *sums), "quality-strata")
    langs = rows.count()
    own = F.when(F.col("held") >= least(langs + 1), F.col("lang_")).alias("stratum_")
    share = EPSILON / (2 * len(CUTOFFS))
    total = rows.groupBy(own).agg(F.sum("n").alias("n"), *[F.sum(f"`{n}`").alias(n) for ns in names.values() for n in ns])

    def strictest(f: str) -> Column:
        """Index of the last cutoff that rejects no more than its share; counts only grow along cutoffs."""
        fine = F.array(*[(F.col("n") > 0) & (F.col(f"`{n}`") <= share * F.col("n")) for n in names[f]])
        return (F.size(F.filter(fine, lambda x: x)) - 1).alias(f"at_{f}")

    def cutoff(f: str, notch: int | Column) -> Column:
        at = F.col(f"at_{f}") - notch
        return F.when(at >= 0, F.get(F.array(*map(F.lit, CUTOFFS[f])), at))

    found = total.select("stratum_", *map(strictest, CUTOFFS))
    settings = written(_with(rows.select("lang_", own), found), "quality-settings")
    rejects = [F.count_if(_any(F.col(f) > cutoff(f, s) for f in CUTOFFS)).alias(f"k{s}") for s in NOTCHES]
    held = good.where(~F.col("pick_")).join(sized(settings, langs, STRATUM_BYTES), "lang_")
    tests = held.groupBy("stratum_").agg(F.count("*").alias("n"), *rejects)
    level = DELTA / (langs + 1)
    passed = F.array(*[below(F.col("n"), F.col(f"k{s}"), level) for s in NOTCHES], F.lit(False))
    tests = tests.select("stratum_", (F.array_position(passed, F.lit(False)).cast("int") - 2).alias("last_"))
    notch = F.get(F.array(*map(F.lit, NOTCHES)), F.col("last_"))
    cuts = [F.when(F.col("last_") >= 0, cutoff(f, notch)).alias(f"cut_{f}") for f in CUTOFFS]
    return _with(settings, tests).select("lang_", "stratum_", *cuts), langs


def _with(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows with what more has of their stratum, the joint one (null) included."""
    more = more.withColumnRenamed("stratum_", "same_")
    return rows.join(more, F.col("stratum_").eqNullSafe(F.col("same_")), "left").drop("same_")


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def cutoffs(good: DataFrame) -> dict[tuple[str, str], float]:
    """cutoff_table as (language, feature) -> cutoff, for few languages with a
    stratum of their own. Rows without key_ are numbered."""
    if "key_" not in good.columns:
        good = good.withColumn("key_", F.monotonically_increasing_id())
    return {(r["lang_"], f): r[f"cut_{f}"] for r in cutoff_table(good)[0].where("stratum_ is not null").collect() for f in CUTOFFS if r[f"cut_{f}"] is not None}


def verdict(joint: dict[str, float | None]) -> Column:
    """True where a rule rejects. joint: cutoffs of languages without labels."""
    return _any(F.col(f) > F.when(F.col("known_"), F.col(f"cut_{f}")).otherwise(F.lit(joint[f]).cast("double")) for f in CUTOFFS)


def judged(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of docs (all, if not said; it has text, doc_id and
    perhaps lang) plus the counts, base_failed and kept. Conflicting labels of one document count as bad.
    Empty tables, or no labels, leave the base rules alone. Texts may be of any
    length; repeated rows get equal results; a feature equal to a cutoff passes."""
    named = {c.lower() for c in docs.columns}
    carry = [c for c in carry or docs.columns if c.lower() not in {*COUNTS, "kept"}]
    if not {"doc_id", "text"} <= named:
        raise ValueError("docs needs doc_id and text")
    rows = measured(docs, carry)
    feats = written(rows.select("own_", "key_", "lang_", *COUNTS, *CUTOFFS), "quality-features")
    best = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    good = feats.where("not base_failed").select("key_", "lang_", *CUTOFFS).join(best, F.col("key_") == F.col("doc_id"), "left_semi")
    found, langs = cutoff_table(good)
    cuts = written(found, "quality-cutoffs")
    first = cuts.where("stratum_ is null").first()
    joint = {f: first[f"cut_{f}"] if first else None for f in CUTOFFS}
    cuts = cuts.withColumn("known_", F.lit(True)).drop("stratum_")
    rows = feats.join(sized(cuts, langs, STRATUM_BYTES), "lang_", "left").withColumn("known_", F.coalesce("known_", F.lit(False)))
    return rows.select("own_.*", *COUNTS, (~F.col("base_failed") & ~verdict(joint)).alias("kept"))
