"""Operators against plain-Python models of the rules, and the sources."""

import random
import statistics
import zipfile

import numpy as np
from pyspark.sql import functions as F


def thresholds(values):
    v = sorted(values)
    if not any(v) or v[-1] - v[0] < 80:
        return 200, 245
    gaps = [b - a for a, b in zip(v, v[1:], strict=False)]
    a = next((v[i] + g / 2 for i, g in enumerate(gaps) if i >= 2 and g > max(gaps) / 2), None)
    b = next((v[i] + g / 2 for i, g in enumerate(gaps) if i >= 2 and g > 50 + statistics.mean(gaps[: i - 1])), None)
    if a is None and b is None:
        return 200, 245
    return (min(a, b), max(a, b)) if None not in (a, b) else ((a or b) - 1, a or b)


def test_adaptive_thresholds(spark):
    from tallyforge.operators.votes import adaptive_thresholds

    rng = random.Random(1)
    ballots = {i: [rng.choice([rng.randint(0, 60), rng.randint(150, 830)]) for _ in range(rng.randint(1, 14))] for i in range(300)}
    df = spark.createDataFrame([(b, k, p) for b, ps in ballots.items() for k, p in enumerate(ps)], "ballot_id long, opt_ord int, pmv int")
    got = {r["ballot_id"]: (r["marginal"], r["definite"]) for r in adaptive_thresholds(df).collect()}
    assert got == {b: thresholds(p) for b, p in ballots.items()}


def test_vote_evaluation(spark):
    from tallyforge.operators.votes import evaluated

    rng = random.Random(2)
    rows, want = [], {}
    for b in range(300):
        vote_for, kinds = rng.randint(1, 3), [rng.choice(["NoMark", "MarginalMark", "DefiniteMark"]) for _ in range(rng.randint(1, 6))]
        d = kinds.count("DefiniteMark")
        free, votes = vote_for - d, []
        for k in kinds:
            promoted = k == "MarginalMark" and free > 0
            free -= promoted
            votes.append(int(d <= vote_for and (k == "DefiniteMark" or promoted)))
        want[b] = (int(d > vote_for), 0 if d > vote_for else max(free, 0), votes)
        rows += [(b, "c", str(i), i, vote_for, k, int(k == "DefiniteMark")) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "ballot_id long, contest string, option string, opt_ord int, vote_for int, has_indication string, num_marks int")
    got = {}
    for r in evaluated(df).orderBy("ballot_id", "opt_ord").collect():
        got.setdefault(r["ballot_id"], (r["overvotes"], r["undervotes"], []))[2].append(r["num_votes"])
    assert got == want


def test_chunks_are_even(spark):
    from tallyforge.operators.index import chunked

    for n, most in ((1, 7), (59, 7), (401, 50), (200, 200)):
        sizes = [r["count"] for r in chunked(spark.range(n), most, ["id"]).groupBy("chunk_idx").count().orderBy("chunk_idx").collect()]
        k = -(-n // most)
        assert sizes == [n // k + (i < n % k) for i in range(k)]


def test_contest_tree(spark):
    from tallyforge.operators.index import adjacency

    styles = [["a", "b", "c"], ["a", "c"], ["b"]]
    df = spark.createDataFrame([(s, i, c) for s, cs in enumerate(styles) for i, c in enumerate(cs)], "style int, ord int, item string")
    got = {tuple(r) for r in adjacency(df, "style", "item", "ord").collect()}
    assert got == {(None, "a"), ("a", "b"), ("b", "c"), ("c", None), ("a", "c"), (None, "b"), ("b", None)}


def test_card_codes(spark):
    from tallyforge.functions import bits

    def style(code):
        core = code >> 20 & 0xFFFF
        s = sum(a for m, v, a in bits.mask_rows() if core & m == v)
        party = bits.PARTY.get(code >> 48 & 0xFF)
        return s + 1000 * party if code.bit_count() % 2 and s <= 211 and party is not None else None

    rng = random.Random(3)
    codes = [rng.choice([0x21, 0x31, 0x29, 0x40]) << 48 | rng.getrandbits(16) << 20 | rng.getrandbits(3) for _ in range(500)]
    df = spark.createDataFrame([(c,) for c in codes], "c long").select("c", bits.card_style(F.col("c")).alias("s"))
    assert all(r["s"] == style(r["c"]) for r in df.collect())
    one = spark.createDataFrame([(22454, 3, 9), (22455, 5, 9), (57, 1, 0)], "code long, bt int, v int")
    got = [tuple(r) for r in one.select(*bits.effective_style(F.col("code"), F.col("bt"), F.col("v"))).collect()]
    assert [s for _, s in got] == [0, 1 - 1 if 22455 % 57 % 2 else 1, 1]


def test_text_rules(spark):
    from tallyforge.functions import text as t

    df = spark.createDataFrame([("PCT310/Republican Party\\87195i.pdf", "O Jané “Doe” ★", "abc", "abd")], "p string, o string, a string, b string")
    r = df.select(t.folder(F.col("p"), 0).alias("f0"), t.folder(F.col("p"), 1).alias("f1"), t.folder(F.col("p"), 2).alias("f2"), t.ballot_id(F.col("p")).alias("id"), t.sanitized(F.col("o")).alias("s"), t.indel_ratio("a", "b").alias("i"), t.line_count(F.lit("a\nb")).alias("n")).first()
    assert tuple(r) == ("PCT310", "Republican Party", None, "87195", 'Jane "Doe"', 2 * 2 / 6, 2)


def test_nearest_and_boxes(spark):
    from tallyforge.operators import geometry as g

    rng = random.Random(5)
    marks = sorted({(k, rng.randint(0, 300)) for k in range(3) for _ in range(12)})
    rows = [(i, rng.randrange(3), rng.randint(-20, 320)) for i in range(80)]
    got = g.nearest(spark.createDataFrame(rows, "id int, k int, y int"), "k", "y", spark.createDataFrame(marks, "k int, m int"), "m", ["id"])
    for r in got.collect():
        own = [m for k, m in marks if k == r["k"]]
        assert r["nearest"] == min(own, key=lambda m: (abs(m - r["y"]), m))
    boxes = [(0, 0, 0, 0, 10, 10), (0, 1, 2, 2, 3, 3), (0, 2, 2, 2, 3, 3), (1, 0, 0, 0, 9, 9)]
    left = g.not_containing(spark.createDataFrame(boxes, "page int, idx int, x int, y int, w int, h int"), "page", "idx")
    assert {(r["page"], r["idx"]) for r in left.collect()} == {(0, 2), (1, 0)}


def test_archives_and_pixels(spark, tmp_path):
    from tallyforge.operators import mapping
    from tallyforge.sources import archives

    img = np.full((40, 64), 255, np.uint8)
    img[5:15, 8:20] = 0
    pbm = b"P4\n# made\n64 40\n" + np.packbits(img == 0, axis=1).tobytes()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("box/1F.pbm", "box/1R.pbm", "box/2F.pbm", "box/thumbs.db"):
            z.writestr(name, pbm)
    rows = archives.images(archives.members(spark, f"file://{tmp_path}/*.zip", content=True))
    assert rows.count() == 3
    pairs = {r["ballot_id"]: r["file_paths"] for r in archives.paired(rows).collect()}
    assert pairs == {"1": ["box/1F.pbm", "box/1R.pbm"], "2": ["box/2F.pbm"]}
    targets = spark.createDataFrame([("s", "c", "yes", 4, 2), ("s", "c", "no", 30, 10)], "style_num string, contest string, option string, x int, y int")
    values = mapping.pixel_values(rows.where("path = 'box/2F.pbm'").select(F.lit("2").alias("ballot_id"), F.lit("s").alias("style_num"), "content"), targets)
    assert {r["option"]: r["pmv"] for r in values.collect()} == {"yes": 120, "no": 0}


def test_election_files(spark, tmp_path):
    from tallyforge.sources import election as e

    (tmp_path / "eif.csv").write_text('# a comment\nofficial_contest_name,vote_for,official_options,description,writein_num\n"#off",1,x,,\nMayor,2,"Ann, Bob ,Cy",,2\n,,,,\nBond,,"Yes,No","Shall\nwe?",\nMayor,9,z,,\n')
    c = e.contests(e.user_csv(spark, f"file://{tmp_path}/eif.csv", e.EIF))
    got = {r["contest"]: r for r in c.collect()}
    assert got["Mayor"]["vote_for"] == 2 and got["Mayor"]["official_options"] == ["Ann", "Bob", "Cy"] and got["Mayor"]["writein_options"] == ["writein_0", "writein_1"]
    assert got["Bond"]["vote_for"] == 1 and got["Bond"]["writein_num"] == 0 and got["Bond"]["descr_num"] == 2 and len(got) == 2
    bof = spark.createDataFrame([("Mayor", "Bob", "ROBERT")], "official_contest_name string, official_option string, ballot_option string")
    assert [r["ballot_option"] for r in e.ballot_options(c.where("contest = 'Mayor'"), bof).orderBy("opt_ord").collect()] == ["Ann", "ROBERT", "Cy"]
    wide = spark.createDataFrame([("1", "P", "S", "Ann", "undervote", " "), ("2", "P", "S", "overvote", "overvote", "Yes")], ["Cast Vote Record", "Precinct", "Ballot Style", "Mayor", "Unnamed: 4", "Bond"])
    rows = {(r["ballot_id"], r["contest"], r["slot"]): r["selection"] for r in e.long_cvr(wide, wide.columns[:3]).collect()}
    assert rows == {("1", "Mayor", 0): "Ann", ("1", "Mayor", 1): "undervote", ("2", "Mayor", 0): "overvote", ("2", "Mayor", 1): "overvote", ("2", "Bond", 0): "Yes"}
    text = '{"Sessions": [{"TabulatorId": 12, "BatchId": 3, "RecordId": 45, "SessionType": "x", "Original": {"BallotTypeId": 7, "Cards": [{"Id": 22454}]}}, {"TabulatorId": 1, "BatchId": 1, "RecordId": 1, "Original": {"BallotTypeId": 2, "Cards": []}}]}'
    s = e.sessions(spark.createDataFrame([(text,)], "value string")).orderBy("ballot_id").collect()
    assert [(r["ballot_id"], r["card_code"]) for r in s] == [("00001_00001_000001", 0), ("00012_00003_000045", 22454)]
    m = e.style_matrix(spark.createDataFrame([("Mayor", "1", ""), ("Bond", "1", "1")], ["contest", "10", "11"]), "contest")
    assert {tuple(r) for r in m.collect()} == {("10", "Mayor"), ("10", "Bond"), ("11", "Bond")}


def test_mapping(spark):
    from tallyforge.operators import mapping

    rois = spark.createDataFrame([("s", i, t) for i, t in enumerate(["Header", "MAYOR", "Ann Lee", "B0b Ray", "Bond", "Yes", "No"])], "style_num string, roi_idx int, ocr_text string")
    contests = spark.createDataFrame([("s", 0, "Mayor", ["Ann Lee", "Bob Ray"]), ("s", 1, "Bond", ["Yes", "No"]), ("s", 2, "Judge", ["Retain"])], "style_num string, contest_ord int, contest string, options array<string>")
    got = {(r["contest"], r["option"]): (r["roi_idx"], r["ok"]) for r in mapping.mapped(rois, contests).collect()}
    assert got == {("Mayor", "Ann Lee"): (2, True), ("Mayor", "Bob Ray"): (3, True), ("Bond", "Yes"): (5, True), ("Bond", "No"): (6, True), ("Judge", "Retain"): (-1, False)}


def test_settings():
    from tallyforge.sources.settings import merged

    spec = [{"name": "n", "type": "int", "default": "5"}, {"name": "on", "type": "bool"}, {"name": "src", "multi": True, "required": True}, {"name": "vendor", "choices": ["A", "B"], "default": "A"}]
    assert merged(spec, [("src", "x"), ("src", "y"), ("n", "1,200 ballots"), ("on", "Yes")], {"vendor": "B"}) == ({"n": 1200, "on": True, "src": ["x", "y"], "vendor": "B"}, [])
    assert merged(spec, [("on", "maybe"), ("vendor", "C"), ("odd", "1")])[1] == ["unknown setting odd", "on: not yes or no: 'maybe'", "missing src", "vendor: not among the choices"]


def test_streamed_marks(spark, tmp_path):
    import datetime

    from tallyforge.streaming import marks

    t = datetime.datetime(2024, 1, 1)
    for i, rows in enumerate([[(1, "c", "a", 1, 1, t), (2, "c", "a", 1, 0, t)], [(1, "c", "a", 2, 0, t), (3, "c", "b", 1, 1, t)]]):
        spark.createDataFrame(rows, marks.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = marks.upserted(marks.arriving(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck")
        assert q.awaitTermination(120)
        state = {r["ballot_id"]: r["num_votes"] for r in spark.read.schema(marks.SCHEMA).parquet(f"{tmp_path}/out/v={i}").collect()}
    assert state == {1: 0, 2: 0, 3: 1}


def test_lookups_ask_for_all_rows(spark):
    """Every event of a user with marks has its nearest one, every ballot is looked up."""
    import collections

    from tallyforge.plans import layout, registry
    from tallyforge.sources import tables

    at, found = "/root/testdata/sf0.001", registry.queries()
    marks, events = collections.defaultdict(set), layout._events(spark, at).collect()
    for e in events:
        if e["event_type"] == "view" or e["event_id"] % 5 == 0:
            marks[e["user_id"]].add(e["pos"])
    want = sorted((e["event_id"], e["user_id"], e["pos"], float(min(marks[e["user_id"]], key=lambda m: (abs(m - e["pos"]), m)))) for e in events if marks[e["user_id"]])
    assert sorted(tuple(r) for r in found["nearest_mark_all"](spark, at).collect()) == want
    pmvs = collections.defaultdict(list)
    for m in tables.marks(spark, at).collect():
        pmvs[m["ballot_id"], m["contest"]] += [m["pmv"]] if m["option"] == "Brand#11" else []
    want = sorted((b, c, "Brand#11", max(p, default=999), len(p) > 1) for (b, c), p in pmvs.items())
    assert sorted(tuple(r) for r in found["pmv_lookup_all"](spark, at).collect()) == want
