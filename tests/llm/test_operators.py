"""Each operator against a brute-force version on small tables, and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None, None), (2, "", "en"), (3, "  \n\t ", "en"), (None, "no id here at all, and some more words follow it now", "fr"), (4, "same text of some words here", "en"), (4, "same text of some words here", "en"), (5, "Ünïcode é 😀 text", "xx"), (6, long, "en"), (7, "a\x00b\x85c d", "en")]
    clashing = {"n_words": 9, "score": 8.0, "key": "k", "kept": True, "fp": "fp", "bins": "b", "hits": 3, "w_": 5, "u_": 0.5, "own_": "o", "key_": 1, "copies": 7, "a": 2, "ids": "i"}
    return spark.createDataFrame([(i, t, lang, "s", 1, *clashing.values()) for i, t, lang in rows], ["doc_id", "text", "lang", "source", "n_chars", *clashing])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 0, 0), (4, 1, 0), (4, 0, 0), (5, 1, 1), (6, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


# ---- secrets


def base_secrets(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_secret_automaton_equals_expressions():
    from tallyforge.llm import secret_scan as s

    scanner = s.Scanner(s.default_tables())
    rng = random.Random(5)
    parts = ["secret=", "token", "=", " ", '"', ":", "AKIA", "ABCD", "0123", "abcdef0123", "api_key", "APIkey", "é", 'passwd : "', "xoxb-", "eyJ", ".", "a" * 4200, "f" * 5000]
    for _ in range(600):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        assert [g for g in s.scan(x, scanner) if g[0] in s.BASE] == base_secrets(x)
    assert [g[0] for g in s.scan("see https://bob:hunter2@host and ghp_" + "a1B2" * 9, scanner)] == ["login", "github"]


def test_secret_scan_of_long_runs():
    """Very many starts that lead nowhere are not followed one by one; what matches after them is still found."""
    import time

    from tallyforge.llm import secret_scan as s

    scanner, began = s.Scanner(s.default_tables()), time.perf_counter()
    assert s.scan("eyJ" * 40_000, scanner) == [] and s.scan("://a" * 30_000, scanner) == []
    assert time.perf_counter() - began < 60
    token = "eyJabcdefghij.eyJabcdefghij.abcdefghij"
    x = "eyJ" * 2000 + f" {token} " + "eyJ" * 500
    assert [(k, x[a:b]) for k, a, b in s.scan(x, scanner)] == [("jwt", token)]
    rng = random.Random(8)
    for _ in range(300):
        x = "".join(rng.choice(["eyJ", "eyJabcdefgh", ".", "abcdefgh", "://", "u:", "p@", " ", "x" * 300]) for _ in range(rng.randint(1, 40)))
        for kind in ("jwt", "login"):
            assert [x[a:b] for k, a, b in s.scan(x, scanner) if k == kind] == [m[0] for m in re.finditer(s.MORE[kind], x)]


def test_secret_automaton_is_minimal():
    from tallyforge.llm import secret_scan as s

    rows, marks, _ = s.compiled([s.parse("ab|cb")], False)
    assert len(rows) == 4 and sum(map(bool, marks)) == 1  # start, after a or c, accepting, dead


def test_secret_query(spark, awkward, empty):
    from tallyforge.llm import queries, secret_scan

    for r in queries.op1_secrets(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        base = base_secrets(r["text"])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b[0] == k for b in base) for k in ("assign", "access", "hex")]
    assert secret_scan.secrets(awkward).count() == 9 and secret_scan.secrets(empty).count() == 0


# ---- mixing


def test_mixing_meets_targets(spark, awkward, labels, empty, no_labels):
    from tallyforge.llm import mixing

    at = SF.replace("0.001", "0.01")  # fewer labels don't tell the domains apart
    docs, lab = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    r = mixing.mixed(docs, lab).toPandas()
    assert len(r) == docs.count() and (r["rate"] >= 0).all() and abs(r[[f"p_{d}" for d in mixing.DOMAINS]].sum(axis=1) - 1).max() < 1e-9
    total = r["n_tokens"].sum()
    for d, share in mixing.TARGETS.items():
        assert abs((r["n_tokens"] * r[f"p_{d}"] * r["rate"]).sum() / total - share) < 0.02
    assert mixing.repeated(mixing.mixed(docs, lab), ["doc_id"]).count() == r["copies"].sum()
    a = mixing.mixed(awkward, labels)
    assert a.count() == 9 and a.where("n_tokens is null or rate is null or copies is null").count() == 0
    assert mixing.mixed(awkward, no_labels).count() == 9 and mixing.mixed(empty, labels).count() == 0


def test_projected_steps_equal_least_squares(spark):
    """Against a dense solver's non-negative fit of the same residuals."""
    from tallyforge.llm import mixing

    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    n = rng.integers(5, 200, 300)
    df = spark.createDataFrame([(int(a), *map(float, q)) for a, q in zip(n, p)], "n_tokens long, p_good double, p_toxic double, p_low double")
    target = {"good": 0.7, "toxic": 0.1, "low": 0.2}
    moves, reached = mixing.fitted(df, target)
    got = {d: v / n.sum() for d, v in reached.items()}
    assert all(abs(got[d] - target[d]) < 2e-3 for d in target)
    rates = [r["r"] for r in df.select(mixing.rate(moves).alias("r")).collect()]
    assert min(rates) >= 0


def dense_nonnegative(a, b):
    """Non-negative least squares by the active-set method on dense matrices."""
    x, active = np.zeros(a.shape[1]), []
    for _ in range(10 * a.shape[1]):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        if slope.max() <= 1e-13:
            break
        active.append(int(slope.argmax()))
        while True:
            z = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if z.min() > 0:
                break
            part = min(x[j] / (x[j] - v) for j, v in zip(active, z) if v <= 0)
            x[active] += part * (z - x[active])
            active = [j for j in active if x[j] > 1e-14]
            x[[j for j in range(len(x)) if j not in active]] = 0
        x[:] = 0
        x[active] = z
    return x


@pytest.mark.parametrize("shape,share", [((0.4, 0.4, 0.4), (0.7, 0.1, 0.2)), ((3, 0.1, 0.1), (0.5, 0.3, 0.2)), ((0.05, 0.05, 3), (0.9, 0.05, 0.05)), ((1, 1, 1), (0.98, 0.01, 0.01))])
def test_rates_equal_dense_solver(spark, shape, share):
    """Rates of a feasible, a hard and an unreachable mix against a dense solver of the same problem."""
    from tallyforge.llm import mixing

    rng = np.random.default_rng(5)
    p, n = rng.dirichlet(shape, 150), rng.integers(5, 200, 150)
    df = spark.createDataFrame([(int(a), *map(float, q)) for a, q in zip(n, p)], "n_tokens long, p_good double, p_toxic double, p_low double").coalesce(1)
    pull, reached = mixing.fitted(df, dict(zip(mixing.DOMAINS, share)))
    weight = n / n.sum()
    ridge = np.sqrt(mixing.RIDGE * weight)
    want = dense_nonnegative(np.vstack([weight * p.T, np.diag(ridge)]), np.concatenate([share, ridge]))
    rates = np.array([r["r"] for r in df.select(mixing.rate(pull).alias("r")).collect()])
    loss = lambda r: float((((weight * r) @ p - share) ** 2).sum() + (mixing.RIDGE * weight * (r - 1) ** 2).sum())
    assert loss(rates) <= loss(want) * (1 + 1e-6) + 1e-10 and rates.min() >= 0
    assert np.allclose([reached[d] / n.sum() for d in mixing.DOMAINS], (weight * rates) @ p)


def test_mixing_says_what_it_misses(spark):
    from tallyforge.llm import mixing

    docs = docs_of(spark, ["plain words of a text that says little " * 3] * 30)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="mixing reaches"):
        assert mixing.mixed(docs, labels, {"good": 0.1, "toxic": 0.8, "low": 0.1}).count() == 30


# ---- quality rules


def quality_counts(text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + i for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for i in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, awkward, labels, empty, no_labels):
    from tallyforge.llm import quality_rules as q

    texts = ["a b c d e " * 3, "one\n two\n\n one\n", "x # | <b>", "", "a b c d e f a b c d e f g", "w " * 50]
    got = {r["doc_id"]: r for r in q.judged(docs_of(spark, texts), no_labels).collect()}
    for i, t in enumerate(texts):
        n = quality_counts(t)
        assert tuple(got[i][c] for c in q.COUNTS[:5]) == n
        assert got[i]["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and got[i]["kept"] == (not got[i]["base_failed"])
    out = q.judged(awkward, labels)
    assert out.count() == 9 and set(awkward.columns) <= set(out.columns) and q.judged(empty, labels).count() == 0
    assert {r["n_words"] for r in out.where("doc_id in (1, 2, 3)").collect()} == {0}


def test_binomial_bound_and_cutoffs(spark):
    from tallyforge.llm import quality_rules as q

    assert abs(q.tail(100, 0, 0.05) - 0.95**100) < 1e-12 and q.tail(10, 9, 0.01) > 0.5
    rows = [("en", 0.25 if i < 8 else 0.0, 0.0, 0.0, 0.0) for i in range(4000)] + [("fr", 0.0, 0.0, 0.0, 0.0)] * 50
    found = q.cutoffs(spark.createDataFrame(rows, "lang_ string, symbol_rate double, upper_rate double, dup_line_rate double, mark_rate double"))
    level = q.DELTA / 8
    want = min(c for i, c in enumerate(q.CUTOFFS["symbol_rate"]) if all(q.tail(4000, 8 if d < 0.25 else 0, q.EPSILON) <= level for d in q.CUTOFFS["symbol_rate"][: i + 1]))
    assert found["en", "symbol_rate"] == want and not [k for k in found if k[0] == "fr"]  # 50 labels prove nothing


def test_quality_cutoffs_of_all_languages(spark):
    """70 languages with labels enough for cutoffs: each rejects its bad documents."""
    from pyspark.sql import functions as F

    from tallyforge.llm import quality_rules as q

    words = "some plain words of a document that goes on for a while"
    bad = F.expr("id % 1800 = 0")
    text = F.when(bad, F.lit(words.replace(" ", "### "))).otherwise(F.lit(words))
    docs = spark.range(70 * 1800).select(F.col("id").alias("doc_id"), text.alias("text"), F.concat(F.lit("l"), F.expr("cast(id div 1800 as string)")).alias("lang"))
    labels = docs.where(~F.expr("doc_id % 1800 = 0")).select("doc_id", F.lit(1).alias("quality"))
    out = q.judged(docs, labels)
    assert out.where("not kept").select("doc_id", "lang").distinct().count() == 70 and out.where("kept").count() == 70 * 1799
    # The tails in Spark are those in Python.
    some = [(n, k) for n in (1, 200, 1700, 4000, 300_000) for k in (0, 1, 3, 8, 20, 1300, 1420, 1500) if k <= n]
    for level in (0.0125, 1e-4, 1e-9):
        got = spark.createDataFrame(some, "n long, k long").select("n", "k", q.below(F.col("n"), F.col("k"), level).alias("b")).collect()
        assert all(r["b"] == (q.tail(r["n"], r["k"], q.EPSILON) <= level) for r in got)


def test_quality_small_strata_are_one(spark):
    """Languages too small to prove anything share cutoffs, those without
    labels too; a stratum whose good documents a rule would reject keeps them."""
    from pyspark.sql import functions as F

    from tallyforge.llm import quality_rules as q

    words = "some plain words of a document that goes on for a while"
    loud = words.upper()  # usual in 'up', never seen in good documents elsewhere
    rows = [(i, loud if i % 3 == 0 else words, "up") for i in range(600)]
    rows += [(1000 + i, words, f"s{i % 40}") for i in range(400)]
    judged = [(5000, loud, "up"), (5001, loud, "s3"), (5002, loud, "new"), (5003, words, "new"), (5004, words.replace(" ", " ### "), "up")]
    docs = spark.createDataFrame(rows + judged, "doc_id long, text string, lang string")
    labels = docs.where("doc_id < 5000").select("doc_id", F.lit(1).alias("quality"))
    kept = {r["doc_id"]: r["kept"] for r in q.judged(docs, labels).where("doc_id >= 5000").collect()}
    assert kept == {5000: True, 5001: False, 5002: False, 5003: True, 5004: False}
    found, langs = q.cutoff_table(docs.where("doc_id < 5000").select(F.col("doc_id").alias("key_"), F.col("lang").alias("lang_"), *[F.lit(0.0).alias(f) for f in q.CUTOFFS]))
    assert langs == 41 and {r["stratum_"] for r in found.collect()} == {"up", None}
    # The least number of holdout documents is just enough for a setting that rejects none of them.
    for m in (1, 5, 71):
        n = q.least(m)
        assert q.tail(n, 0, q.EPSILON) <= q.DELTA / m < q.tail(n - 1, 0, q.EPSILON)


# ---- repeated strings


def repeated(texts):
    """doc_id -> (bytes, removed, spans, hash) by a set of all windows."""
    seen, out = set(), {}
    for i, x in enumerate(texts):
        b = (x or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        flags = gone[:-1].astype(int)
        out[i] = (len(b), int(flags.sum()), int((np.diff(flags, prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[flags == 0])).hexdigest())
    return out


def repeat_cases():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeéf") for _ in range(rng.randint(2, 9)))
    common = " ".join(word() for _ in range(40))
    texts = ["", None, "x" * 99, "y" * 500, "ab" * 200]
    for _ in range(60):
        t = " ".join(word() for _ in range(rng.randint(1, 60)))
        if rng.random() < 0.5:
            k = rng.randint(0, 60)
            t = t[:50] + common[k : k + rng.randint(80, 220)] + t[50:]
        texts.append(t)
    return texts + texts[20:26] + [texts[30][:-1] + "z", common + "!" + common, "q" * 150 + word() + "q" * 150]


@pytest.mark.parametrize("hot,block,shard", [(16384, 1 << 20, 1 << 19), (2, 64, 1500)])
def test_repeated_strings(spark, monkeypatch, hot, block, shard):
    from tallyforge.llm import suffix_dedup as s

    for k, v in (("HOT", hot), ("BLOCK", block), ("SHARD", shard), ("GROUP", 4 * shard)):
        monkeypatch.setattr(s, k, v)
    texts = repeat_cases()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in s.deduplicated(docs_of(spark, texts)).collect()}
    assert got == repeated(texts)


def test_repeated_strings_of_heavy_anchors(spark, monkeypatch):
    """Bytes, not runs, make an anchor hot; what is crowded after it is cut again goes by hashes."""
    from tallyforge.llm import suffix_dedup as s

    rng = random.Random(14)
    body = "".join(rng.choice("abcdefgh") for _ in range(700))
    texts = ["z" * n for n in (4000, 3000, 101)] + [body[:k] + "#" + body[k:] for k in range(120, 600, 60)] + ["xy" * 1500 + body[:300], "w" * 90]
    for heavy, hashed in ((2000, 64), (600, 1 << 16), (1 << 22, 64)):
        monkeypatch.setattr(s, "HEAVY", heavy)
        monkeypatch.setattr(s, "HASHED", hashed)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in s.deduplicated(docs_of(spark, texts)).collect()}
        assert got == repeated(texts)


def test_merge_of_transforms_equals_counting():
    from tallyforge.llm import suffix_dedup as s

    rng = random.Random(4)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 160))).encode() for _ in range(12)]
    strings += [strings[3][5:], strings[4] + b"x", b"p" * 130]
    shards = [s.transform(strings[:6]), s.transform(strings[6:11]), s.transform(strings[11:])]
    entry, _ = s.merged(shards)
    counts = collections.Counter(x[p : p + 100] for x in strings for p in range(len(x) - 99))
    assert len(entry) == sum(c for c in counts.values() if c > 1)


def test_repeated_strings_awkward(spark, awkward, empty):
    from tallyforge.llm import suffix_dedup as s

    out = s.deduplicated(awkward)
    assert out.count() == 9 and s.deduplicated(empty).count() == 0
    assert [r["n_removed"] for r in out.where("doc_id = 4").collect()] == [0, 0]


# ---- classifier


def test_classifier_held_out(spark, awkward, labels, empty, no_labels):
    from tallyforge.llm import classifier, queries

    at = "/root/testdata/sf0.01"
    r = queries.op5_classifier(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").toPandas()
    assert (r["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in r["doc_id"]]).all()
    held = r[r["held_out"]]
    good, bad = (held[held["quality"] == k]["score"].to_numpy() for k in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.97 and ((held["score"] >= 0.3).astype(int) == held["predicted"]).all()
    a = classifier.scored(awkward, labels)
    assert a.count() == 9 and a.where("score is null or score < 0 or score > 1").count() == 0
    assert {x["score"] for x in classifier.scored(awkward, no_labels).collect()} == {0.5}
    assert classifier.scored(empty, labels).count() == 0


def test_votes_equal_plain_loop():
    """Each score against a loop over all labelled vectors, ties included."""
    from tallyforge.llm import classifier as c

    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(60)]
    texts += texts[:20] * 2  # repeats tie
    y = np.array([rng.randint(0, 1) for _ in texts])
    x = np.stack([c.terms(t) for t in texts])
    model = c.Model(x, y, (30, 50))
    asked = np.stack([c.terms(t) for t in [*texts[:15], "", "new words", "### ! " * 9]])
    got = model.score(asked)
    share = [n / (y == k).sum() for k, n in ((0, 30), (1, 50))]
    for row, score in zip(asked, got):
        v = ((c._weighted(row[None], model.idf) - model.mean) @ model.basis)[0]
        cos = [round(float(v @ u / max(1e-12, np.linalg.norm(v))), c.EQUAL) for u in model.vectors]
        near = sorted(range(len(cos)), key=lambda i: (-cos[i], i))[: c.NEIGHBOURS]
        vote = [max(1e-6, cos[i]) ** c.POWER * share[y[i]] for i in near]
        assert abs(score - sum(a for a, i in zip(vote, near) if y[i]) / sum(vote)) < 1e-6
    assert np.allclose(got, [model.score(r[None])[0] for r in asked], atol=1e-9)  # batches make no difference


# ---- personal data


def test_personal_data_base(spark, awkward, empty):
    from tallyforge.llm import pii

    text = "mail a.b@c-d.example.com or 10.0.0.256 and 85.151.219.238, call +1 (582) 555-6123; card 4565410125667261."
    assert [k for k, _, _ in pii.base_spans(text)] == ["email", "ip", *["card"] * pii.luhn("4565410125667261"), "phone"]
    for kind, a, b in pii.base_spans(text):
        assert text[a:b] in ("a.b@c-d.example.com", "85.151.219.238", "+1 (582) 555-6123", "4565410125667261") and kind in pii.KINDS
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    r = pii.personal_data(docs_of(spark, [text, None, ""])).orderBy("doc_id").collect()
    base = pii.base_spans(text)
    assert r[0]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest() and r[1]["spans"] == r[2]["spans"] == ""
    assert pii.personal_data(awkward).count() == 9 and pii.personal_data(empty).count() == 0
    masked = pii.masked(awkward)
    assert masked.count() == 9 and masked.columns == awkward.columns and masked.where("text is null").count() == 1


def test_field_gradient_and_decoding():
    """The gradient against finite differences; decoding against all segmentations."""
    from tallyforge.llm import pii

    text = "call (555) 123-4567 x"
    toks = pii.tokens(text, 0, len(text))
    cands = pii.candidates(text, toks)
    gold = [(next(i for i, t in enumerate(toks) if t[0] == 5), next(i for i, t in enumerate(toks) if t[1] == 19) + 1, 3)]
    w = {(3, "area"): 0.7, (3, ""): -0.2, ("t", 4, 3): 0.1}
    g, base = pii.gradient(w, len(toks), cands, gold)
    for key in [(3, "area"), (3, ""), ("t", 4, 3), (0, ""), ("t", 4, 4)]:
        up = dict(w)
        up[key] = up.get(key, 0.0) + 1e-5
        assert abs((pii.gradient(up, len(toks), cands, gold)[1] - base) / 1e-5 - g.get(key, 0.0)) < 1e-3


def test_field_adds_spans():
    from tallyforge.llm import pii

    w = pii.default_weights()
    text = "th +1 (269) 555-3296 4524132264652876 and"
    assert pii.all_spans(text, w)[0] == [] and [text[a:b] for _, a, b in pii.all_spans(text, w)[1]] == ["4524132264652876", "+1 (269) 555-3296"]
    rng = random.Random(77)
    hit = found = real = 0
    for _ in range(150):
        t, gold = pii._made(rng)
        got = {(k, a, b) for k, a, b, s in pii.decoded(w, t, 0, len(t)) if s >= pii.MARGIN}
        hit, found, real = hit + len(got & set(gold)), found + len(got), real + len(gold)
    assert hit / found > 0.95 and hit / real > 0.95


def plain_spans(text):
    """Base spans by the contract's own expressions, with no thought of time."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_personal_data_base_equals_expressions():
    from tallyforge.llm import pii

    rng = random.Random(31)
    parts = ["a", "b@", "@", ".", "1", "22", "+", "+1", " ", "_", "c.d", "..", "-", "1.2", "%", "255", "256", "4539578763621486", "(5", ") ", "é"]
    for _ in range(3000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(x) == plain_spans(x)


def test_personal_data_in_long_texts():
    import time

    from tallyforge.llm import pii

    w = pii.default_weights()
    mail = "a@b.co "
    for text, base in (("0" * 5000 + "1.1.1.1", 1), ("1" * 1_000_000, 0), ("a" * 1_000_000 + "7", 0), ("x" * 1_000_000 + "@", 0), (mail * 30_000, 30_000), ("+ " * 200_000 + "5", 0), ("." * 300_000 + "1" * 300_000, 0)):
        began = time.perf_counter()
        got = pii.all_spans(text, w)
        assert len(got[0]) == base and time.perf_counter() - began < 4  # well below a second each on an idle machine


def test_field_decoding_equals_all_segmentations(monkeypatch):
    """The best of all segmentations, scored one by one."""
    from tallyforge.llm import pii

    w = pii.default_weights()

    def every(n, cands, at=0, last=pii.OUTSIDE):
        if at == n:
            yield 0.0, ()
            return
        for k, j, s in [(pii.OUTSIDE, at + 1, 0.0)] + [(k, j, s) for j, own in cands.items() for i, f in own if i == at for k, s in enumerate(pii.scores(w, f)) if s > 0]:
            for v, rest in every(n, cands, j, k):
                yield v + w.get(("t", last, k), 0.0) + s, ((at, j, k), *rest)

    for text in ("call (555) 123-4567 x", "a 1.2.3.4 b", "bob [at] ex [dot] com 5551234567", "+1 (269) 555-3296 4524132264652876", "x@y.zz 555.123.4567"):
        toks = pii.tokens(text, 0, len(text))
        best, segments = max(every(len(toks), pii.candidates(text, toks)))
        want = [(pii.KINDS[k], toks[i][0], toks[j - 1][1]) for i, j, k in segments if k != pii.OUTSIDE]
        assert [g[:3] for g in pii.decoded(w, text, 0, len(text))] == want
    # Letting go of what is settled changes nothing; stretches find what whole texts hold.
    rng = random.Random(3)
    text = " and so on, it goes. ".join(pii._made(rng)[0] for _ in range(120))
    whole = pii.decoded(w, text, 0, len(text))
    monkeypatch.setattr(pii, "SETTLE", 2)
    assert pii.decoded(w, text, 0, len(text)) == whole
    apart = [g for a, b in pii._apart(pii.stretches(text)) for g in pii.decoded(w, text, a, b)]
    assert [g[:3] for g in apart] == [g[:3] for g in whole]


def test_field_against_base_spans_of_documents(spark):
    """The field alone, on what the base patterns find in real texts, and on forms that they can't find."""
    from tallyforge.llm import pii

    w = pii.default_weights()
    hit = found = real = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        if base := set(pii.base_spans(r["text"])):
            got = {g[:3] for a, b in pii._apart(pii.stretches(r["text"])) for g in pii.decoded(w, r["text"], a, b) if g[3] >= pii.MARGIN}
            hit, found, real = hit + len(got & base), found + len(got), real + len(base)
    assert real > 30 and hit / real > 0.95 and hit / found > 0.95
    for text, kind in (("write to bob [at] example [dot] com today", "email"), ("ring (555) 123-4567 now", "phone"), ("or bob @ example.com there", "email")):
        assert [k for k, _, _ in pii.all_spans(text, w)[1]] == [kind]
    for text in ("a (at) b x", "on 2020-10-11 at 12:30", "1 2 3 4 5 6 7 8 9", "v1.2.3 and 10,000.50", "5 @ 3.50 each"):
        assert pii.all_spans(text, w)[1] == []


# ---- near-duplicates


def test_simhash_components(spark, awkward, empty):
    from tallyforge.llm import simhash

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(3)]
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    for hot in (16384, 2):
        simhash.HOT, old = hot, simhash.HOT
        try:
            links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
        finally:
            simhash.HOT = old
        parent = {f: f for f in signed}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in links:
            a, b = find(r["src"]), find(r["dst"])
            parent[max(a, b)] = min(a, b)
        want = {f: f for f in signed}
        v = np.array(fps, np.uint64)
        for i in range(len(fps)):
            for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 3) + i + 1:
                a, b = find(signed[i], want), find(signed[j], want)
                want[max(a, b)] = min(a, b)
        assert [find(f) for f in signed] == [find(f, want) for f in signed]
    out = simhash.near_duplicates(awkward).collect()
    assert len(out) == 9 and {r["component_id"] for r in out if r["doc_id"] in (1, 2, 3)} == {1} and simhash.near_duplicates(empty).count() == 0


def test_simhash_keys_stay_together(spark, monkeypatch):
    """Groups of one key must reach the comparison whole when the join before
    it is shuffled and only turned into a broadcast while it runs."""
    from tallyforge.llm import common, simhash

    rng = random.Random(12)
    fps = []
    for _ in range(400):
        fp = rng.getrandbits(64)
        for _ in range(12):  # chains of close fingerprints
            fps.append(fp)
            fp ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    signed = np.array(sorted(set(fps)), np.uint64).view(np.int64)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "10m", "adaptive.advisoryPartitionSizeInBytes": "64k"}
    conf = {f"spark.sql.{k}": v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = simhash.links(common.written(spark.createDataFrame([(int(v),) for v in signed], "fp long").repartition(6), "test-fp")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    root = {int(v): int(v) for v in signed}

    def find(x, parent):
        while parent[x] != x:
            x = parent[x]
        return x

    found = dict(root)
    for r in got:
        a, b = find(r["src"], found), find(r["dst"], found)
        found[max(a, b)] = min(a, b)
    u = signed.view(np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 3) + i + 1:
            a, b = find(int(signed[i]), root), find(int(signed[j]), root)
            root[max(a, b)] = min(a, b)
    assert [find(int(v), found) for v in signed] == [find(int(v), root) for v in signed]


def test_fingerprint_bits():
    import xxhash

    from tallyforge.llm.simhash import fingerprint

    text = "The Quick É fox " * 200 + "jumps over it"
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    assert fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert fingerprint(" \n") == 0 and fingerprint("one two") == xxhash.xxh64_intdigest(b"one two", 42)


# ---- neighbours


def test_nearest_recall_and_ties(spark):
    from tallyforge.llm import ann

    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[7]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9050, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y = x.astype(float)
    n = np.linalg.norm(y, axis=1)
    hit = total = 0
    for i in range(0, 1500, 50):
        s = y @ y[i] / (n * n[i])
        s[i] = -9
        best = sorted(range(1500), key=lambda j: (-round(s[j], 12), j))[:5]
        hit, total = hit + len({v for v, _ in got[i]} & set(best)), total + 5
        assert len(got[i]) == 5 and all(abs(s[v] - c) < 1e-12 for v, c in got[i])
    assert hit / total >= 0.9 and 9050 not in got
    assert [v for v, _ in got[150]] == [7, 100, 101, 102, 103]
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, "x"), (1, [-1.0, 0.1], 2, "y"), (2, [0.0, 1.0], 3, "z")], "vec_id long, embedding array<float>, id int, v string")
    assert [r["vec_id"] for r in ann.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [2, 1]
    assert ann.nearest(few.limit(0), few).count() == 0


def test_nearest_of_doubles(spark, monkeypatch):
    """Scores of double vectors lose nothing; products one by one equal those in a matrix."""
    from tallyforge.llm import ann

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    n = np.linalg.norm(x, axis=1)
    rows = []
    for sparse in (1 << 40, 0):
        monkeypatch.setattr(ann, "SPARSE", sparse)
        rows.append(ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect())
        assert all(abs(r["score"] - x[r["vec_id"]] @ x[r["query_id"]] / (n[r["vec_id"]] * n[r["query_id"]])) < 1e-14 for r in rows[-1])
    assert rows[0] == rows[1] and len(rows[0]) == 30


def test_nearest_repeated_ids(spark):
    """One vec_id in most rows of every chunk, another with many vectors: both
    count once, and their neighbours are found."""
    from tallyforge.llm import ann

    rng = np.random.default_rng(8)
    hot = rng.normal(size=16)
    x = hot + rng.normal(size=(60, 16)) * np.where(np.arange(60) < 40, 0.3, 3.0)[:, None]
    rows = [(i, v) for i, v in enumerate(x)] + [(100, hot)] * 5000 + [(101, hot + d) for d in rng.normal(size=(500, 16)) * 0.02]
    rng.shuffle(rows := [(i, v.astype(np.float32).tolist()) for i, v in rows])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id < 20")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids, y = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    n = np.linalg.norm(y, axis=1)
    hit = 0
    for i in range(20):
        q = y[ids == i][0]
        s, most = y @ q / (n * np.linalg.norm(q)), {}
        for j, c in zip(ids.tolist(), s.tolist()):
            if j != i:
                most[j] = max(c, most.get(j, -9))
        best = sorted(most, key=lambda j: (-most[j], j))[:5]
        hit += len({v for v, _ in got[i]} & set(best))
        assert len({v for v, _ in got[i]}) == 5 and all(c <= most[v] + 1e-12 for v, c in got[i])
    assert hit >= 90
    one = lambda a: ann._best(*map(np.array, a), 2)
    assert [v.tolist() for v in one(([0] * 4, [7, 7, 7, 8], [0.9, 0.8, 0.7, 0.6]))] == [[0, 0], [7, 8], [0.9, 0.6]]


# ---- pages


def test_main_text():
    from tallyforge.llm.html_text import main_text

    page = """<html><head><title>T</title><style>p{}</style></head><body class="x"><header><h2>Site</h2></header><nav><a href="/">Home</a></nav>
    <div class="cookie-notice">We use cookies</div><div id="content"><article><h1>Head&amp;line</h1><p>First   <b>para</b>graph.<p>Second &#233;<br>line<script>var a="<p>no</p>";</script>
    <ul><li>one<li>two</ul><form><input><button>Send</button></form><div class="ad">Buy now</div></article><section class="comments"><p>A reader wrote a very long comment here, longer than all else in it.</p></section></div>
    <aside>Side</aside><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "Head&line First paragraph. Second é line one two"
    assert main_text("") == "" and main_text("<nav>only menu</nav>") == "" and main_text("plain words") == "plain words"
    assert main_text("<div><p>" + "long text here " * 30 + "</p><p>more of it, and more</p></div><div><a href=x>link</a> <a href=y>links</a></div>").startswith("long text here")
    assert main_text("<p>" * 3000 + "deep <b>" * 3000) == ("deep " * 3000).strip()


def test_main_text_in_marked_wrappers():
    from tallyforge.llm.html_text import main_text

    text = "A long enough paragraph of the page, with some more words in it. " * 4
    want = text.strip()
    article, plain = f"<article><p>{text}</p></article>", f"<p>{text}</p>"
    side = '<div class="sidebar"><p>Side words</p></div><div id="comments"><article class="comment"><p>A reader</p></article></div><footer>Foot</footer>'
    for inner in (article, plain):
        for wrap in ('div class="content has-sidebar"', 'div id="page-with-comments"', 'section class="social-history"', 'form id="aspnetForm" method="post"', 'div class="widget"'):
            end = wrap.split()[0]
            assert main_text(f"<body><{wrap}>{inner}{side}</{end}></body>") == want
    assert main_text(f'<form><fieldset><label>Name</label><input><div class="page-header">x</div>{article}<button>Go</button></fieldset></form>') == want
    # What the listed parts hold is still left out, however long it is.
    assert main_text(f'<main>{plain}<section class="related"><article><p>Teaser</p></article></section></main>') == want
    assert main_text(f'<main><article><p>{text}</p></article><div id="comments" class="comments-area">{"<article><p>Reader words and more</p></article>" * 60}</div></main>') == want
    assert main_text(f'<div><p>{text}</p></div><form class="search"><p>Subscribe to our letter</p><input></form>') == want


def test_main_text_threshold():
    """Beside the core, only what reaches the least density on its path is kept."""
    from tallyforge.llm.html_text import main_text

    text = "A long enough paragraph of the page, with some more words in it. " * 4
    thin = "<div>" + "".join(f"<div><span><b>{w}</b></span><i>x</i></div>" for w in "mon tue wed thu fri sat".split()) + "</div>"
    core = f"<div>{f'<p>{text}</p>' * 5}</div>"
    assert main_text(f"<div><h1>Hi</h1>{core}<p>{text}</p>{thin}</div>") == "Hi " + (text * 6).strip()
    assert main_text(f"<div>{core}So <b>it</b> is.{thin}</div>") == (text * 5).strip() + " So it is."
    # An article is whole.
    assert main_text(f"<article>{core}{thin}</article>").endswith("satx")


def brute_main_text(page):
    """Composite text density by plain recursion over html.parser's events, for
    well-formed pages of blocks, inline elements and links."""
    import math
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        root = here = ["body", [], None]

        def handle_starttag(self, tag, attrs):
            if tag != "body":
                new = [tag, [], self.here]
                self.here[1].append(new)
                self.here = new

        def handle_endtag(self, tag):
            self.here = self.here[2] or self.here

        def handle_data(self, data):
            self.here[1].append(data)

    parser = Tree()
    parser.root = parser.here = ["body", [], None]
    parser.feed(page)
    body = parser.root
    kids = lambda n: [p for p in n[1] if not isinstance(p, str)]
    chars = lambda n: len(" ".join(n.split())) if isinstance(n, str) else sum(map(chars, n[1]))
    tags = lambda n: sum(1 + tags(k) for k in kids(n))
    link = lambda n: 0 if isinstance(n, str) else sum(chars(k) if k[0] == "a" else link(k) for k in kids(n))
    link_tags = lambda n: sum((k[0] == "a") + link_tags(k) for k in kids(n))

    def density(n):
        c, t, lc, lt = chars(n), tags(n), link(n), link_tags(n)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + link(body) / max(1, chars(body)) * c + math.e)
        return c / max(1, t) * math.log(max(math.e, c / max(1, lc) * max(1, t) / max(1, lt))) / max(1.0, base)

    def nodes(n):
        return [n] + [x for k in kids(n) for x in nodes(k)]

    best = max(nodes(body), key=lambda n: sum(map(density, kids(n))))
    path = [best]
    while path[-1][2]:
        path.append(path[-1][2])
    limit = min((density(n) for n in path[1:]), default=0.0)
    inline = lambda p: isinstance(p, str) or p[0] in ("a", "b", "i", "span")
    text = lambda p: p if isinstance(p, str) else "".join(map(text, p[1])) if inline(p) else " " + "".join(map(text, p[1])) + " "

    def dense(n):
        return " ".join(text(k) if density(k) >= limit else dense(k) for k in kids(n) if not inline(k))

    def shown(i):
        n = path[i]
        if i == 0:
            return text(n)
        out, run = [], []
        for p in [*n[1], None]:
            if p is not None and inline(p) and p is not path[i - 1]:
                run.append(p)
                continue
            if 2 * sum(chars(q) if not isinstance(q, str) and q[0] == "a" else link(q) for q in run) <= sum(map(chars, run)):
                out += map(text, run)
            run = []
            if p is not None:
                out.append(" " + shown(i - 1) + " " if p is path[i - 1] else text(p) if p[0] == "h2" or density(p) >= limit else " " + dense(p) + " ")
        return "".join(out)

    return " ".join(shown(len(path) - 1).split()) if chars(body) else ""


def test_main_text_equals_plain_density():
    from tallyforge.llm.html_text import main_text

    rng = random.Random(21)
    words = lambda n: " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 9))) for _ in range(n)) + rng.choice(("", ".", " "))

    def inline():
        kind = rng.random()
        return words(rng.randint(1, 25)) if kind < 0.6 else f"<a href=x>{words(rng.randint(1, 4))}</a>" if kind < 0.8 else f"<b>{words(2)}</b>"

    def block(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"<p>{''.join(inline() for _ in range(rng.randint(0, 4)))}</p>"
        if rng.random() < 0.15:
            return "<ul>" + "".join(f"<li><a href=x>{words(2)}</a></li>" for _ in range(rng.randint(1, 6))) + "</ul>"
        if rng.random() < 0.1:
            return f"<h2>{words(3)}</h2>"
        tag = rng.choice(("div", "section"))
        return f"<{tag}>{''.join(block(depth - 1) if rng.random() < 0.8 else inline() for _ in range(rng.randint(0, 5)))}</{tag}>"

    changed = 0
    for _ in range(300):
        page = "<body>" + "".join(block(3) for _ in range(rng.randint(1, 6))) + "</body>"
        got = main_text(page)
        assert got == brute_main_text(page)
        changed += got != main_text(page, 0.0) or got != main_text(page, 4.0)
    assert changed > 100  # the threshold decides


def test_main_text_of_awkward_pages():
    """Unclosed quotes and tags that are closed but not open, at length."""
    import time

    from tallyforge.llm.html_text import main_text

    n, began = 20_000, time.perf_counter()
    assert main_text("<p>text" + "<a " * n + '"') == "text"
    assert main_text("<i><div>" + "<b>" * n + "</i>" * n + "x") == "x" and main_text("<b>" * n + "<hr>" * n + "x") == "x"
    assert main_text("</div></p></b>" * n + "x <p don't>y<p title=\"it's > \">z") == "x y z"
    assert time.perf_counter() - began < 20


def test_pages_query(spark):
    from tallyforge.llm import html_text, queries

    at = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")
    for r in queries.op9_html_text(spark, SF).join(at, "page_id").collect():
        import html as h

        inner = r["html"].split("<article>")[1].split("</article>")[0]
        assert r["text"] == " ".join(h.unescape(re.sub("<[^>]*>", " ", inner)).split()) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, None, None, "t", 5), (None, "u", "", "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    long = "<article>" + "<p>word &amp; more</p>" * 40_000 + "</article>"
    assert html_text.main_text(long) == ("word & more " * 40_000).strip() and html_text.main_texts(odd.limit(0)).count() == 0
    assert [(r["text"], r["n_chars"]) for r in html_text.main_texts(odd).collect()] == [("", 0), ("", 0)]


# ---- packing


def test_packing_round_trip(spark, awkward, empty):
    from tallyforge.llm import packing

    encode = packing.Encoder(packing.default_tokenizer())
    for x in ("it's I'LL don't 5²x ½ ÀÉ É ǅ ß'd 'S", "a\xa0b İΣΣ x\x85y", "x<|endoftext|>y", "", "Grüße, œuvre 12.5%!!"):
        assert encode(x) == encode.whole(x)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pieces = packing.pack(docs).toPandas()
    for i, g in pieces.sort_values("start").groupby("doc_id"):
        assert b"".join(g["ids"]) == encode.whole(texts[i]) + b"\x01\0\0\0"
        assert list(g["start"]) == [0, *np.cumsum(g["length"])[:-1]] and (g["doc_tokens"] == g["length"].sum()).all()
    padding = 0
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and (n := g["length"].sum()) <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding == 0 and set(pieces["doc_id"]) == set(texts)
    a = packing.digest(packing.pack(awkward)).toPandas()
    assert a["doc_id"].isna().sum() == 1 and len(a[a["doc_id"] == 4]) == 2 and (a[a["doc_id"] == 1]["length"] == 1).all()
    assert packing.pack(empty).count() == 0


def test_packing_special_tokens_and_long_texts(spark, monkeypatch):
    """Ids against a fresh tokenizer; a text of very many windows."""
    from tokenizers import Tokenizer

    from tallyforge.llm import packing

    fresh = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.Encoder(packing.default_tokenizer())
    for x in ("hello <|endoftext|> world", "<|STARTOFTEXT|>x", "a <|x|> b", "<|endoftext|>", "it's 5 o'clock", "é<|endoftext|>"):
        assert list(np.frombuffer(encode(x), "<u4")) == fresh.encode(x, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "WINDOW", 2)
    texts = ["a b c", " ".join(["word"] * 70_000), "d", "", " ".join(["more"] * 40_001)]
    pieces = packing.pack(docs_of(spark, texts).coalesce(1)).toPandas()
    assert pieces["length"].sum() == sum(len(fresh.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    assert not pieces.duplicated(["sequence_id", "offset"]).any() and pieces.groupby("sequence_id")["length"].sum().max() == 2
    assert (pieces.groupby("sequence_id")["offset"].min() == 0).all()


def test_packing_tail():
    from tallyforge.llm import packing

    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randint(1, 12) for _ in range(rng.randint(1, 40))]
        total = rng.randint(0, sum(lengths))
        got = packing.subset(lengths, total)
        reach = {0}
        for v in lengths:
            reach |= {r + v for r in reach}
        assert (got is None) == (total not in reach) and (got is None or sum(lengths[i] for i in got) == total and len(set(got)) == len(got))
        begun = rng.randint(0, 9)
        assert sorted(packing.tail(lengths, begun)) == sorted(lengths)
    assert packing.tail([7, 7, 1, 1, 3], 0) and packing.tail([], 0) == []


def test_packing_plan():
    from tallyforge.llm import packing

    rng = np.random.default_rng(3)
    counts = rng.integers(0, 60, packing.WINDOW)
    counts[0] = 9
    rows, seqs, residual = packing.plan(counts)
    used = collections.Counter()
    for v, lo, hi, seq, _at, _step in rows:
        assert used[v] == lo and hi > lo
        used[v] = hi
    assert all(used[v] == counts[v] for v in range(1, packing.WINDOW))
    assert seqs * packing.WINDOW + residual == (counts * np.arange(packing.WINDOW)).sum() and residual < 0.3 * seqs * packing.WINDOW


# ---- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality_rules", "simhash_near_duplicates", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs
    from tallyforge.llm.common import written

    seen = {}
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SF), "test")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == names
    assert seen["quality_rules"].count() < before.count() and 0 < seen["simhash_near_duplicates"].count() < seen["quality_rules"].count()
    from tallyforge.llm import pii, simhash

    groups = simhash.near_duplicates(seen["quality_rules"])
    assert seen["simhash_near_duplicates"].count() == groups.select("component_id").distinct().count()
    assert all(not pii.base_spans(r["text"]) for r in seen["pii"].collect())
    assert cp.run(spark, SF).count() == seen["packing"].count()


def test_pipeline_awkward(spark, awkward, tmp_path):
    import corpus_pipeline as cp

    at = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, awkward.select(*cp.COLUMNS), at).count() >= 0

    empty_docs = awkward.select(*cp.COLUMNS).limit(0)
    assert all(stage(spark, empty_docs, at).count() == 0 for _, stage in cp.STAGES)
    kept = {name: stage(spark, awkward.select(*cp.COLUMNS), at).collect() for name, stage in cp.STAGES}
    assert {r["doc_id"] for r in kept["quality_rules"]} == {None, 6}  # the others have fewer than ten words
    assert sorted(str(r["doc_id"]) for r in kept["simhash_near_duplicates"]) == ["1", "4", "5", "6", "7", "None"]
    assert len(kept["pii"]) == 9 and len(kept["mixing"]) == 9  # one domain, whose target is nearly all
    assert {r["doc_id"] for r in kept["packing"]} == {None, 1, 2, 3, 4, 5, 6, 7}


def test_pipeline_equals_brute_force(spark):
    """Each stage's rows from its input by plain Python."""
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    from tallyforge.llm import mixing, packing, pii, quality_rules, simhash
    from tallyforge.llm.common import table, written

    docs = table(spark, SF, "documents")
    out = {}
    for name, stage in cp.STAGES:
        out[name] = written(stage(spark, docs, SF), "brute"), docs
        docs = out[name][0]
    rows = {name: ([r.asDict() for r in a.collect()], [r.asDict() for r in b.collect()]) for name, (a, b) in out.items()}
    # Quality: the base rules; labels are too few here for cutoffs.
    after, before = rows["quality_rules"]
    fine = {r["doc_id"] for r in before if (n := quality_counts(r["text"]))[0] >= 10 and 100 * n[4] <= 20 * n[0]}
    assert {r["doc_id"] for r in after} == fine and quality_rules.cutoffs(spark.createDataFrame([("en", 0.0, 0.0, 0.0, 0.0)] * 99, "lang_ string, symbol_rate double, upper_rate double, dup_line_rate double, mark_rate double")) == {}
    # Near-duplicates: all pairs of fingerprints.
    after, before = rows["simhash_near_duplicates"]
    fps = {r["doc_id"]: simhash.fingerprint(r["text"]) & (1 << 64) - 1 for r in before}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {r["doc_id"] for r in after} == {find(i) for i in ids}
    # Personal data: what is between base spans stays.
    after, before = rows["pii"]
    texts = {r["doc_id"]: r["text"] for r in after}
    for r in before:
        spans = pii.all_spans(r["text"], pii.default_weights())[1]
        assert set(pii.base_spans(r["text"])) <= set(spans) and texts[r["doc_id"]] == pii.masked_text(r["text"], spans) and (spans or texts[r["doc_id"]] == r["text"])
    # Mixing: floor(rate + u) copies of whole rows.
    after, before = rows["mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(out["pii"][0], table(spark, SF, "labels")).collect()}
    assert collections.Counter(r["doc_id"] for r in after) == collections.Counter({i: n for i, n in copies.items() if n})
    assert {(r["doc_id"], r["text"]) for r in after} <= {(r["doc_id"], r["text"]) for r in before}
    # Packing: pieces joined are the library's ids.
    after, before = rows["packing"]
    fresh = Tokenizer.from_file(packing.default_tokenizer())
    want = collections.Counter((r["doc_id"], len(fresh.encode(r["text"], add_special_tokens=False).ids) + 1) for r in before)
    whole = collections.Counter()
    for r in after:
        whole[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert whole == collections.Counter({k: k[1] * n for k, n in want.items()})
