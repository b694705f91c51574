"""Ballot archives: ZIP members as rows."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Successive members of an archive that one task reads.
RUN = 64

#: Which members are ballot images, by extension.
IMAGES = {"pdf": r".*\.pdf$", "pbm": r".*[FR]\.pbm$", "tif": r".*\.tiff?$", "png": r".*\.png$"}


def _opened(path: str):
    """An archive as a seekable file, of which only what is asked for is read:
    its directory first, then members. Any file system that Arrow knows."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return system.open_input_file(at)


def listed(spark: SparkSession, glob: str, pattern: str = ".*") -> DataFrame:
    """archive, member (raw name), path (with /), ext, size, source and place of
    each member whose path matches. Only directories of archives are read, so
    an archive may be larger than memory."""
    schema = "archive string, member string, path string, ext string, size long, source string, place int"

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        want = re.compile(pattern)
        for pdf in batches:
            for source in pdf["path"]:
                rows = []
                with _opened(source) as f, zipfile.ZipFile(f) as z:
                    for i, info in enumerate(z.infolist()):
                        path = info.orig_filename.replace("\\", "/")
                        if not info.is_dir() and want.fullmatch(path):
                            rows.append((source.rsplit("/", 1)[-1], info.orig_filename, path, path.rpartition(".")[2].lower() if "." in path else "", info.file_size, source, i))
                yield pd.DataFrame(rows, columns=["archive", "member", "path", "ext", "size", "source", "place"])

    return spark.read.format("binaryFile").load(glob).select("path").mapInPandas(expand, schema)


def contents(rows: DataFrame) -> DataFrame:
    """rows of listed() (with what was joined to them) plus content. Runs of
    RUN members are dealt over tasks, which read these members alone."""
    dealt = rows.repartition("source", F.floor(F.col("place") / RUN)).sortWithinPartitions("source", "place")
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, archive, members = None, None, []
        try:
            for b in batches:
                for at in range(0, b.num_rows, 16):
                    part = b.slice(at, 16)
                    data = []
                    for source, place in zip(part.column("source").to_pylist(), part.column("place").to_pylist(), strict=True):
                        if source != name:
                            if archive is not None:
                                archive.close()
                            name, archive = source, zipfile.ZipFile(_opened(source))
                            members = archive.infolist()
                        data.append(archive.read(members[place]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], [*part.schema.names, "content"])
        finally:
            if archive is not None:
                archive.close()

    return dealt.mapInArrow(read, schema)


def members(spark: SparkSession, glob: str, content: bool = False, pattern: str = ".*") -> DataFrame:
    """archive, member, path, ext, size and, if asked for, content."""
    rows = listed(spark, glob, pattern)
    return (contents(rows) if content else rows).drop("source", "place")


def images(rows: DataFrame) -> DataFrame:
    """Members that are ballot images; other extensions are left out."""
    keep = F.lit(False)
    for ext, pattern in IMAGES.items():
        keep = keep | ((F.col("ext").startswith(ext)) & F.col("path").rlike(f"(?i){pattern}"))
    return rows.where(keep)


def paired(rows: DataFrame) -> DataFrame:
    """One row per ballot: front and back (F, R) of .pbm files together,
    other files alone. file_paths are sorted, so the front comes first; size is
    the first one's."""
    base = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    ballot = F.when(F.col("ext") == "pbm", F.regexp_replace(base, "[FR]$", "")).otherwise(base)
    return rows.withColumn("ballot_id", ballot).groupBy("archive", "ballot_id").agg(F.sort_array(F.collect_list("path")).alias("file_paths"), F.min_by("size", "path").alias("size"))
