"""A whole audit of a made election: archives of images to reports."""

import zipfile

import numpy as np
import pytest

PLACES = {"Ann": (10, 10), "Bob": (60, 10), "writein_0": (110, 10), "Yes": (10, 60), "No": (60, 60)}


def image(filled):
    img = np.full((100, 160), 255, np.uint8)
    for name, (x, y) in PLACES.items():
        n = filled.get(name, 2)  # rows of dark pixels in the target
        img[y : y + n, x : x + 36] = 0
    return b"P5\n160 100\n255\n" + img.tobytes()


BALLOTS = {  # rows filled per target: 26 are a full mark, 6 a marginal one
    "101": {"Ann": 26, "Yes": 26}, "102": {"Bob": 26, "No": 26}, "103": {"Ann": 26, "Bob": 26, "Yes": 26}, "104": {}, "105": {"writein_0": 26, "No": 26}, "106": {"Ann": 26, "No": 26}, "107": {"Ann": 26},
}
RECORDS = {"101": ("Ann", "Yes"), "102": ("Bob", "No"), "103": ("overvote", "Yes"), "104": ("undervote", "undervote"), "105": ("write-in:", "No"), "106": ("Bob", "No"), "108": ("Ann", "Yes")}


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    from tallyforge.plans import jobs
    from tallyforge.sources.sinks import Store

    at = tmp_path_factory.mktemp("audit")
    with zipfile.ZipFile(at / "box.zip", "w") as z:
        for b, filled in BALLOTS.items():
            z.writestr(f"P1/{b}F.pbm", image(filled))
            z.writestr(f"P1/{b}R.pbm", image({}))
    (at / "eif.csv").write_text("# contests\nofficial_contest_name,vote_for,official_options,description,writein_num\nMayor,1,\"Ann,Bob\",,1\nBond,1,\"Yes,No\",\"Shall\nwe?\",\n")
    (at / "cvr.csv").write_text("Cast Vote Record,Precinct,Ballot Style,Mayor,Bond\n" + "".join(f"{b},P1,7,{m},{q}\n" for b, (m, q) in RECORDS.items()))
    (at / "failing.txt").write_text("102\n\n999\n")
    settings = {"archives": f"file://{at}/*.zip", "eif": f"file://{at}/eif.csv", "cvr": f"file://{at}/cvr.csv", "failing": f"file://{at}/failing.txt", "ballots_per_chunk": 4, "results": ["pmv_histogram"]}
    return jobs.Job(spark, Store(spark, f"file://{at}/store"), settings)


def rows(job, name, *cols):
    return {tuple(r[c] for c in cols) for r in job.table(name).collect()}


def test_audit(spark, job):
    from tallyforge.plans import jobs

    jobs.run(job, "load_contests", "load_cvr", "cvr2styles", "genbif_from_cvr", "create_bif_report", "build_template_tasklists")
    assert rows(job, "bif", "ballot_id") == {(b,) for b in BALLOTS if b in RECORDS} and job.table("bif_report").first()["ballots"] == 6
    assert rows(job, "log", "key", "code") == {("107", "no record")}
    assert job.table("style_contests").first()["contests"] == ["Mayor", "Bond"] and '"contest":"Bond"' in job.table("style_json").first()["json"]
    assert job.table("bif").where("ballot_id = '101'").first()["file_paths"] == ["P1/101F.pbm", "P1/101R.pbm"]
    rois = [("7", i, t, *PLACES.get(t, (0, 0))) for i, t in enumerate(["Mayor", "Ann", "Bob", "Bond", "Yes", "No"])]
    job.store.save(spark.createDataFrame(rois, "style_num string, roi_idx int, ocr_text string, x int, y int"), "rois")
    jobs.run(job, "maprois", "build_extraction_tasks", "extractvote", "genreport")
    assert job.table("extraction_tasks").select("chunk").distinct().count() == 2 and job.table("marks").count() == 24
    pmv = {(r["ballot_id"], r["option"]): r["pmv"] for r in job.table("marks").collect()}
    assert pmv["101", "Ann"] == 936 and pmv["101", "Bob"] == 72
    assert rows(job, "contest_totals", "contest", "overvotes", "undervotes", "tot_votes", "num_ballots") == {("Mayor", 1, 2, 3, 6), ("Bond", 0, 1, 5, 6)}
    assert rows(job, "option_totals", "contest", "option", "votes") == {("Mayor", "Ann", 2), ("Mayor", "Bob", 1), ("Bond", "Yes", 2), ("Bond", "No", 3)}
    jobs.run(job, "cmpcvr", "gen_cmpcvr_report", "check_extraction", "get_discrepancy_list", "plotmetrics", "save_failing_ballots")
    assert rows(job, "discrepancies", "ballot_id") >= {("106",)} and ("101",) not in rows(job, "discrepancies", "ballot_id")
    assert rows(job, "differences", "ballot_id", "vote_difference") == {("106", '{"Ann":1,"Bob":-1}')}
    assert job.table("cmp_flags").where("blank").first()["ballot_id"] == "104" and job.table("cmp_flags").where("overvoted").first()["ballot_id"] == "103"
    assert rows(job, "missing", "ballot_id", "missing") == {("108", "marks")} and rows(job, "failing", "ballot_id") == {("102",)}
    s = job.table("cmp_summary").first()
    assert (s["processed"], s["blank"], s["overvoted"]) == (job.table("cmp_ballots").count(), 1, 1)
    job.store.save(spark.createDataFrame([("106", "Mayor", "Ann", 1, 1), ("106", "Mayor", "Ann", 2, 0)], "ballot_id string, contest string, option string, ssidx int, num_votes int"), "rulings")
    jobs.run(job, "submit_adjudications", "delete_results")
    assert job.table("adjudicated").where("ballot_id = '106' and option = 'Ann'").first()["num_votes"] == 0 and job.store.load("pmv_histogram") is None


def test_extraction_goes_on_where_it_stopped(spark, job):
    from tallyforge.plans import jobs

    jobs.run(job, "load_contests", "load_cvr", "cvr2styles", "genbif_from_cvr")
    job.settings["exclude_ballots"] = ["101"]
    job.store.save(spark.createDataFrame([("7", i, t, *PLACES.get(t, (0, 0))) for i, t in enumerate(["Mayor", "Ann", "Bob", "Bond", "Yes", "No"])], "style_num string, roi_idx int, ocr_text string, x int, y int"), "rois")
    jobs.run(job, "maprois", "build_extraction_tasks")
    job.store.drop("marks")
    jobs.run(job, "extractvote")
    assert job.table("marks").where("ballot_id = '101'").count() == 0
    before = job.store.files("marks", r".*\.parquet")
    jobs.run(job, "extractvote")  # nothing is left to do
    assert job.store.files("marks", r".*\.parquet") == before and job.table("marks").count() == 20
    del job.settings["exclude_ballots"]
    with pytest.raises(LookupError):
        job.table("never")


def test_sheets_and_sinks(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyforge.operators import reports
    from tallyforge.plans.jobs import races
    from tallyforge.sources import sheets, sinks

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    strings = ["Cast Vote Record", "Precinct", "Style", "Mayor", "Unnamed: 4", "Bond", "Ann", "Yes"]
    head = "".join(f'<c r="{c}1" t="s"><v>{i}</v></c>' for i, c in enumerate("ABCDEF"))
    body = '<c r="A2"><v>17</v></c><c r="B2" t="inlineStr"><is><t>P1</t></is></c><c r="C2"><v>7</v></c><c r="D2" t="s"><v>6</v></c><c r="F2" t="s"><v>7</v></c>'
    drawing = '<d:wsDr xmlns:d="x"><d:oneCellAnchor><d:from><d:col>4</d:col><d:row>1</d:row></d:from></d:oneCellAnchor></d:wsDr>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1">{head}</row><row r="2">{body}</row></sheetData></worksheet>')
        z.writestr("xl/drawings/drawing1.xml", drawing)
    got = sheets.cast_votes(sheets.read(spark, f"file://{tmp_path}/*.xlsx")).collect()
    assert {tuple(r) for r in got} == {("17", "P1", "7", "Mayor", 0, "Ann"), ("17", "P1", "7", "Mayor", 1, "write-in:"), ("17", "P1", "7", "Bond", 0, "Yes")}
    page = '<h1>x</h1><section class="race"><h2>City &amp; Mayor</h2><table><tr><th>n</th></tr><tr><td><b>Ann</b> Lee</td><td>DEM</td><td>61.5%</td><td>1,234</td></tr></table></section>'
    r = races(spark.createDataFrame([(page,)], "html string"), "html")
    assert [tuple(x) for x in r.collect()] == [("City &amp; Mayor", "Ann Lee", "DEM", 61.5, 1234)] and sinks.starter_metadata(r).first()["official_options"] == "Ann Lee"
    (tmp_path / "w.tsv").write_text('level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t10\t20\t30\t9\t96.5\t"Jane\n')
    assert sinks.word_rows(spark, f"file://{tmp_path}/w.tsv").first()["text"] == '"Jane'
    store = sinks.Store(spark, f"file://{tmp_path}/s")
    store.save(spark.range(3).withColumn("c", F.col("id") % 2), "t", chunk="c")
    store.save(spark.createDataFrame([(9, 1)], "id long, c long"), "t", chunk="c")
    assert {r["id"] for r in store.load("t").collect()} == {0, 2, 9}
    store.save(spark.range(2), "u", "csv")
    assert store.load("u", fmt="csv").count() == 2 and store.load("u", "id long", "csv").agg(F.sum("id")).first()[0] == 1 and store.drop("u") and not store.exists("u")
    with pytest.raises(ValueError):
        store.path("../x")
    members = spark.createDataFrame([("1", "a/1F.pbm", bytearray(b"x")), ("2", "a/2F.pbm", bytearray(b"y"))], "ballot_id string, path string, content binary")
    assert [r["size"] for r in sinks.member_copies(members, spark.createDataFrame([("2",)], "ballot_id string"), F.lit(f"{tmp_path}/copies")).collect()] == [1] and (tmp_path / "copies/2F.pbm").read_bytes() == b"y"
    html = reports.page(spark.createDataFrame([("<b>", 1), (None, 2)], "a string, b int"), "T & U", 1)
    assert "&lt;b&gt;" in html and "T &amp; U" in html and "More than 1 rows" in html


def test_templates_to_regions(spark, job):
    """Mean templates, regions from their ink, words in them, combined operations."""
    from tallyforge.plans import jobs

    jobs.run(job, "load_contests", "load_cvr", "cvr2styles")
    words = [("7", 0, 12, 11, 8, 2, "Ann"), ("7", 1, 62, 11, 8, 2, "Bob"), ("7", 2, 12, 61, 8, 2, "Yes"), ("7", 3, 62, 61, 8, 2, "No"), ("7", 4, 5, 95, 3, 3, "lost")]
    job.store.save(spark.createDataFrame(words, "style_num string, word_ord int, x int, y int, w int, h int, text string"), "words")
    job.settings["columns"] = 3
    jobs.run(job, "alltemplates")
    t = job.table("templates").first()
    assert (t["style_num"], t["h"], t["w"]) == ("7", 100, 160)
    rois = {r["ocr_text"]: r for r in job.table("rois").where("ocr_text <> ''").collect()}
    assert set(rois) == {"Ann", "Bob", "Yes", "No"} and rois["Ann"]["x"] == 0 and rois["Ann"]["y"] == 10 and rois["No"]["y"] == 60
    assert job.table("mapping_status").count() == 1
    job.store.drop("words")
    jobs.run(job, "genmaprois")
    assert job.table("rois").where("ocr_text <> ''").count() == 0


def test_index_flags(spark, job):
    """Printed summaries by file size or record; an index from codes alone."""
    from tallyforge.plans import jobs

    jobs.run(job, "load_cvr")
    job.settings |= {"vendor": "ES&S", "bmd_bytes": 10_000}
    jobs.run(job, "genbif_from_cvr")
    assert job.table("bif").where("is_bmd").count() == 0
    job.settings["bmd_bytes"] = 25_000
    jobs.run(job, "genbif_from_cvr")
    assert job.table("bif").where("not is_bmd").count() == 0
    from pyspark.sql import functions as F

    cvr = job.table("cvr").withColumn("is_bmd", F.col("ballot_id") == "102")
    rows_ = [tuple(r) for r in cvr.collect()]
    job.store.save(spark.createDataFrame(rows_, cvr.schema), "cvr")
    del job.settings["vendor"]
    jobs.run(job, "genbif_from_cvr")
    assert rows(job, "bif", "ballot_id", "is_bmd") >= {("102", True), ("101", False)}
    good = (0x21 << 48) | (0x20 << 20)
    job.store.save(spark.createDataFrame([("101", good), ("102", good ^ 1)], "ballot_id string, code long"), "codes")
    jobs.run(job, "genbif_from_ballots")
    found = rows(job, "bif", "ballot_id", "style_num", "precinct")
    assert len(found) == 1 and next(iter(found))[2] == "P1"


def test_archives_are_read_in_part(spark, tmp_path, monkeypatch):
    """Directories first, then only the members asked for, in runs."""
    from tallyforge.sources import archives

    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("dir/", "")
            for i in range(10):
                z.writestr(f"dir/{i}.png", f"{name}{i}" * 50)
    monkeypatch.setattr(archives, "RUN", 3)
    found = archives.listed(spark, f"file://{tmp_path}/*.zip", r"dir/[^9]\.png")
    assert found.count() == 18 and {r["size"] for r in found.collect()} == {100}
    some = archives.contents(found.where("path like '%3.png' or path like '%7.png'"))
    assert {(r["archive"], r["path"]): bytes(r["content"]).decode() for r in some.collect()} == {(f"{n}.zip", f"dir/{i}.png"): f"{n}{i}" * 50 for n in "ab" for i in (3, 7)}


def test_pages_of_a_report(spark):
    from tallyforge.operators import reports

    got = list(reports.pages(spark.range(25), "T", 10))
    assert len(got) == 3 and sum(p.count("<td>") for p in got) == 25 and "T (3)" in got[2] and len(list(reports.pages(spark.range(0), "T", 10))) == 1
