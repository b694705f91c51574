"""The operations of an audit by name, each from tables of a job's store to
tables of it. `run` does several in order; done chunks are not done again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, text
from ..operators import compare, index, mapping, reports, styles, tabulate, validate, votes
from ..operators import images as pictures
from ..sources import archives, election
from ..sources.sinks import Store


@dataclass
class Job:
    """A store and settings: archives (glob), eif, bof, cvr (paths), ballots
    per chunk and template, include/exclude lists of styles and ballots."""

    spark: SparkSession
    store: Store
    settings: dict = field(default_factory=dict)

    def __getitem__(self, name: str):
        return self.settings.get(name)

    def table(self, name: str) -> DataFrame:
        got = self.store.load(name)
        if got is None:
            raise LookupError(f"{name} has not been made yet")
        return got


OPS: dict[str, Callable[[Job], None]] = {}


def op(f: Callable[[Job], None]) -> Callable[[Job], None]:
    OPS[f.__name__] = f
    return f


#: Operations that are others in a row.
COMBINED = {
    "genmaprois": ("genrois", "maprois"), "gentrm": ("gentemplates", "genrois", "maprois"), "tltrm": ("build_template_tasklists", "gentemplates", "genrois", "maprois"),
    "alltemplates": ("genbif_from_cvr", "build_template_tasklists", "gentemplates", "genrois", "maprois"), "cmpcvr_and_report": ("cmpcvr", "gen_cmpcvr_report"),
}


def run(job: Job, *names: str) -> None:
    for n in names:
        for m in COMBINED.get(n, (n,)):
            OPS[m](job)


@op
def load_contests(job: Job) -> None:
    """contests, ballot_options from the contest file and its overrides."""
    eif = election.user_csv(job.spark, job["eif"], election.EIF)
    job.store.save(election.contests(eif), "contests")
    bof = election.user_csv(job.spark, job["bof"], ["official_contest_name", "official_option", "ballot_option"]) if job["bof"] else job.spark.createDataFrame([], "official_contest_name string, official_option string, ballot_option string")
    job.store.save(election.ballot_options(job.table("contests"), bof), "ballot_options")


@op
def load_cvr(job: Job) -> None:
    """cvr (long) and cvr_header from a wide file of cast-vote records."""
    wide = job.spark.read.option("header", True).csv(job["cvr"])
    ids = wide.columns[: job["cvr_ids"] or 3]
    job.store.save(election.long_cvr(wide, ids), "cvr")
    order = [(c, i) for i, c in enumerate(dict.fromkeys(x for x in election.carried_headers(wide.columns)[len(ids) :] if x))]
    job.store.save(job.spark.createDataFrame(order, "contest string, contest_ord int"), "cvr_header")


@op
def genbif_from_cvr(job: Job) -> None:
    """bif: ballots of the archives with the style and precinct of their
    record; ballots without a record go to the log and are left out. Printed
    summaries are told by the size of their file where the vendor is ES&S, by
    their record's is_bmd where it has one."""
    files = archives.paired(archives.images(archives.members(job.spark, job["archives"])))
    cvr = job.table("cvr")
    own = cvr.select("ballot_id", "style_num", "precinct").distinct()
    if "is_bmd" in cvr.columns:
        own = own.join(cvr.groupBy("ballot_id").agg(F.bool_or("is_bmd").alias("said_")), "ballot_id")
    indexed(job, files, own, "genbif_from_cvr", "no record")


def indexed(job: Job, files: DataFrame, own: DataFrame, stage: str, missing: str) -> None:
    """bif and the log's rows of files whose ballot is not in own."""
    small = index.summaries(files, job["bmd_bytes"] or index.SUMMARY_BYTES).withColumnRenamed("is_bmd", "small_")
    rows = files.join(own, "ballot_id")
    if job["vendor"] == "ES&S":
        rows = rows.join(small, "ballot_id")
    found = [F.col(c) for c in ("said_", "small_") if c in rows.columns]
    flags = {"is_bmd": F.coalesce(*found, F.lit(False)), "style_roi_corrupted": F.lit(False)}
    job.store.save(rows.withColumns(flags).drop("said_", "small_", "size"), "bif")
    lost = files.join(own, "ballot_id", "left_anti")
    job.store.append_log(validate.exceptions(lost, stage, "ballot_id", F.lit(missing), F.array_join("file_paths", ";")))


@op
def genbif_from_ballots(job: Job) -> None:
    """bif where there are no records: the style follows from the code read off
    each ballot (table codes: ballot_id, code as a number), precinct and party
    from the path. Ballots whose code is unread or odd go to the log."""
    files = archives.paired(archives.images(archives.members(job.spark, job["archives"])))
    path = F.element_at("file_paths", 1)
    place = files.select("ballot_id", text.precinct(path, job["precinct_pattern"] or "", job["precinct_folder_pattern"] or "", job["precinct_folder"] if job["precinct_folder"] is not None else 0).alias("precinct"))
    own = job.table("codes").select("ballot_id", bits.card_style(F.col("code")).cast("string").alias("style_num")).where("style_num is not null")
    indexed(job, files, own.join(place, "ballot_id"), "genbif_from_ballots", "no code")


@op
def gentemplates(job: Job) -> None:
    """templates: the mean front page of each style's template ballots. Pages
    of a style have one size and lie alike (alignment is done before)."""
    tasks = job.table("template_tasks").select("archive", "style_num", F.element_at("file_paths", 1).alias("path"))
    rows = archives.listed(job.spark, job["archives"]).join(tasks, ["archive", "path"])
    job.store.save(pictures.mean_template(archives.contents(rows)), "templates")


@op
def genrois(job: Job) -> None:
    """rois: bands of ink in each template's columns, in reading order, with the
    words (table words: style_num, word_ord, x, y, w, h, text) inside them."""
    rois = pictures.bands(job.table("templates"), job["columns"] or 1)
    words = job.store.load("words")
    if words is None:
        job.store.save(rois.withColumn("ocr_text", F.lit("")), "rois")
    else:
        job.store.save(pictures.with_words(rois, words), "rois")


@op
def create_bif_report(job: Job) -> None:
    bif = job.table("bif").withColumn("party", F.lit(None).cast("string"))
    job.store.save(index.report(bif), "bif_report")
    job.store.save(validate.several(bif, ["ballot_id"]), "bif_repeated")


@op
def build_template_tasklists(job: Job) -> None:
    """template_tasks: the first ballots of each style."""
    rows = index.first_n(job.table("bif"), job["template_ballots"] or 50, "style_num", ["archive", "ballot_id"], job["template_least"] or 1)
    job.store.save(rows, "template_tasks")


@op
def maprois(job: Job) -> None:
    """roismap: regions matched to contests and options per style."""
    c = job.table("contests").select("contest", "contest_ord")
    o = job.table("ballot_options").groupBy("contest").agg(F.transform(F.sort_array(F.collect_list(F.struct("opt_ord", "ballot_option"))), lambda x: x["ballot_option"]).alias("options"))
    per = job.table("style_contests").select("style_num", F.explode("contests").alias("contest")).join(c, "contest").join(o, "contest")
    m = mapping.mapped(job.table("rois"), per.select("style_num", "contest_ord", "contest", "options"), job["slip"] or 3)
    names = job.table("ballot_options").select("contest", "opt_ord", F.col("option").alias("official"), F.col("ballot_option").alias("option"))
    places = job.table("rois").select("style_num", "roi_idx", "x", "y")
    out = m.join(names, ["contest", "option"]).join(places, ["style_num", "roi_idx"], "left")
    vote_for = job.table("contests").select("contest", "vote_for")
    job.store.save(out.join(vote_for, "contest").select("style_num", "contest", F.col("official").alias("option"), "opt_ord", "vote_for", "x", "y", "ok"), "roismap")
    failed = out.groupBy("style_num").agg((~F.bool_and("ok")).alias("style_failed_to_map"))
    job.store.save(failed, "mapping_status")


@op
def build_extraction_tasks(job: Job) -> None:
    """extraction_tasks: ballots to read, in chunks of even size per archive.
    Styles that failed to map are left out."""
    bif = job.table("bif").where("not style_roi_corrupted and not is_bmd")
    good = styles.mapping_failed(bif.select("style_num").distinct(), job.table("mapping_status")).where("not style_failed").select("style_num")
    bif = bif.join(good, "style_num", "left_semi")
    for name, how in (("include_ballots", "left_semi"), ("exclude_ballots", "left_anti")):
        if job[name]:
            bif = bif.join(job.spark.createDataFrame([(b,) for b in job[name]], "ballot_id string"), "ballot_id", how)
            break
    if job["include_styles"]:
        bif = bif.where(F.col("style_num").isin(job["include_styles"]))
    if job["exclude_styles"]:
        bif = bif.where(~F.col("style_num").isin(job["exclude_styles"]))
    rows = index.chunked(bif, job["ballots_per_chunk"] or 200, ["ballot_id"], ["archive"])
    job.store.save(rows.withColumn("chunk", F.format_string("%s_chunk_%d", "archive", "chunk_idx")), "extraction_tasks")


@op
def extractvote(job: Job) -> None:
    """marks: pixel values of all targets of the tasks' ballots, with mark
    classes and votes. Chunks that are there already are left as they are."""
    tasks = job.store.todo(job.table("extraction_tasks"), "chunk", "marks")
    front = tasks.select("archive", "ballot_id", "style_num", "precinct", "chunk", F.element_at("file_paths", 1).alias("path"))
    targets = job.table("roismap").where("ok")
    # Only members that are still to be done are read, in the task that measures them: no image is shuffled.
    rows = archives.listed(job.spark, job["archives"]).join(front, ["archive", "path"]).join(mapping.target_lists(targets), "style_num")
    values = mapping.measured(archives.contents(rows), job["dark"] or 170)
    about = targets.select("style_num", "contest", "option", "opt_ord", "vote_for")
    marks = values.join(front.select("ballot_id", "style_num", "precinct", "chunk"), "ballot_id").join(about, ["style_num", "contest", "option"])
    # The order of targets on the ballot decides which marginal marks are promoted.
    job.store.save(votes.evaluated(votes.classified(votes.with_thresholds(marks))), "marks", chunk="chunk")


@op
def genreport(job: Job) -> None:
    """contest_totals, option_totals, and a page of each."""
    marks = job.table("marks")
    options = job.table("ballot_options").select("contest", "option")
    for name, df in (("contest_totals", tabulate.contest_totals(marks)), ("option_totals", tabulate.option_totals(marks, options))):
        job.store.save(df, name)


@op
def cmpcvr(job: Job) -> None:
    """cmp_options, cmp_contests, cmp_ballots, cmp_flags, differences."""
    marks = job.table("marks")
    known = job.table("ballot_options").select("contest", "option")
    said = job.table("cvr").withColumn("option", compare.clean_selection(F.col("selection")))
    picked = said.join(known, ["contest", "option"]).select("ballot_id", "contest", "option").distinct().withColumn("v_", F.lit(1))
    over = said.where("selection = 'overvote'").select("ballot_id", "contest").distinct()
    # Options of a contest on the record that were not chosen have no vote there.
    listed = said.select("ballot_id", "contest").distinct().join(known, "contest").join(picked, ["ballot_id", "contest", "option"], "left")
    listed = listed.join(over.withColumn("o_", F.lit(1)), ["ballot_id", "contest"], "left")
    record = listed.select("ballot_id", "contest", "option", F.when(F.col("o_").isNotNull(), 0).otherwise(F.coalesce("v_", F.lit(0))).alias("cvr_votes"))
    job.store.save(compare.compared_options(compare.audit_options(marks), record), "cmp_options")
    options = job.table("cmp_options")
    job.store.save(compare.compared_contests(options), "cmp_contests")
    ballots = compare.compared_ballots(job.table("cmp_contests")).join(marks.select("ballot_id", "style_num", "precinct").distinct(), "ballot_id", "left")
    job.store.save(ballots, "cmp_ballots")
    heads = tabulate.ballot_contests(marks)
    job.store.save(heads.groupBy("ballot_id").agg((F.sum("marks") == 0).alias("blank"), (F.sum("overvotes") > 0).alias("overvoted")), "cmp_flags")
    job.store.save(reports.differences(options), "differences")


@op
def gen_cmpcvr_report(job: Job) -> None:
    job.store.save(reports.summary(job.table("cmp_ballots"), job.table("cmp_flags")), "cmp_summary")
    place = job.table("cmp_ballots").select("ballot_id", "precinct").where("precinct is not null")
    job.store.save(reports.precincts(job.table("cmp_contests"), place, job["discrepancy_from"] or 0.0), "cmp_precincts")
    job.store.save(reports.option_differences(job.table("differences")), "cmp_option_differences")


@op
def cvr2styles(job: Job) -> None:
    """style_contests and style_json from the records."""
    cvr = job.table("cvr")
    job.store.save(styles.from_records(cvr, job.table("cvr_header")), "style_contests")
    job.store.save(reports.style_json(job.table("style_contests"), styles.option_names(cvr)), "style_json")


@op
def check_extraction(job: Job) -> None:
    """missing: ballots of the records without marks, and the other way."""
    a, b = job.table("cvr").select("ballot_id").distinct(), job.table("marks").select("ballot_id").distinct()
    job.store.save(a.join(b, "ballot_id", "left_anti").withColumn("missing", F.lit("marks")).unionByName(b.join(a, "ballot_id", "left_anti").withColumn("missing", F.lit("record"))), "missing")


@op
def plotmetrics(job: Job) -> None:
    job.store.save(tabulate.histogram(job.table("marks").select("pmv")), "pmv_histogram")


@op
def get_discrepancy_list(job: Job) -> None:
    job.store.save(job.table("cmp_ballots").where("agreed = 0").select("ballot_id", "precinct", "disagreed"), "discrepancies")


@op
def submit_adjudications(job: Job) -> None:
    """adjudicated: marks with the last ruling of each target taking the
    votes' place. rulings: ballot_id, contest, option, ssidx, num_votes."""
    last = job.table("rulings").groupBy("ballot_id", "contest", "option").agg(F.max_by("num_votes", "ssidx").alias("ruled"))
    marks = job.table("marks").join(last, ["ballot_id", "contest", "option"], "left")
    job.store.save(marks.withColumn("num_votes", F.coalesce("ruled", "num_votes")).drop("ruled"), "adjudicated")


@op
def save_failing_ballots(job: Job) -> None:
    """failing: index rows of the listed ballots, to be extracted again."""
    listed = job.spark.read.text(job["failing"]).select(F.trim("value").alias("ballot_id")).where("ballot_id <> ''").distinct()
    job.store.save(job.table("bif").join(listed, "ballot_id", "left_semi"), "failing")


@op
def delete_results(job: Job) -> None:
    for name in job["results"] or ():
        job.store.drop(name)


@op
def web2eif(job: Job) -> None:
    """starter_eif from saved result pages: rows of contest, option, party."""
    from ..sources.sinks import starter_metadata

    job.store.save(starter_metadata(races(job.spark.read.text(job["pages"], wholetext=True), "value")), "starter_eif", "csv")


def races(pages: DataFrame, column: str) -> DataFrame:
    """contest, option, party, pct, votes of result pages: a race is a section
    of class race with a heading and table rows of candidate, party, share and
    count."""
    race = r'(?s)<(?:div|section)[^>]*class="race"[^>]*>(.*?)</(?:div|section)>'
    cell = r"(?s)<td[^>]*>(.*?)</td>"
    bare = lambda c: text.one_line(F.regexp_replace(c, "<[^>]*>", " "))
    r = pages.select(F.explode(F.regexp_extract_all(column, F.lit(race), 1)).alias("r"))
    r = r.select(bare(F.regexp_extract("r", r"(?s)<h\d[^>]*>(.*?)</h\d>", 1)).alias("contest"), F.explode(F.regexp_extract_all("r", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1)).alias("row"))
    r = r.withColumn("c", F.transform(F.regexp_extract_all("row", F.lit(cell), 1), bare)).where(F.size("c") >= 4)
    number = lambda i, kind: F.regexp_replace(F.get("c", F.lit(i)), "[^0-9.]", "").try_cast(kind)
    return r.select("contest", F.get("c", F.lit(0)).alias("option"), F.get("c", F.lit(1)).alias("party"), number(2, "double").alias("pct"), number(3, "long").alias("votes"))
