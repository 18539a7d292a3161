"""Readers: lists, folders, point tables, manifests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from framelake import schemas as SC
from framelake.functions import names as N
from framelake.operators.layout import lookup, with_position
from framelake.operators.textmatch import contains_join


def required(rows: DataFrame, message: str, where: Column | None = None) -> DataFrame:
    """The same rows; a table without any (for which ``where`` holds) is an error once it is read."""
    none = rows.agg(F.count_if(where if where is not None else F.lit(True)).alias("n")).filter("n = 0")
    guard = none.select(*[F.raise_error(F.lit(message)).cast(f.dataType).alias(f.name) for f in rows.schema])
    return rows.unionByName(guard)


def path_list(lines: DataFrame, base: str) -> DataFrame:
    """One path per line; blank and comment lines dropped, relative ones resolved.  An empty list is an error."""
    t = lines.select(F.trim("value").alias("path")).filter((F.col("path") != "") & ~F.col("path").startswith("#"))
    return required(t.select(N.resolve("path", base).alias("path")), "the list holds no path")


def read_path_list(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    return path_list(spark.read.text(path), base if base is not None else path.rsplit("/", 1)[0])


# Columns that may hold the input path, in order of preference.
PATH_COLUMNS = ["pseudo3d_h5", "input_h5", "h5_path"]


def batch_items(table: DataFrame, base: str, out_dir: str, suffix: str = "_points") -> DataFrame:
    """Inputs of a batch run with derived name and output; given overrides win."""
    have = [c for c in PATH_COLUMNS if c in table.columns]
    path = F.col(have[0] if have else table.columns[0])
    rows = table.withColumn("_p", N.blank_to_null(path)).filter(F.col("_p").isNotNull() & ~F.col("_p").startswith("#"))
    over = lambda c: N.blank_to_null(c) if c in table.columns else F.lit(None).cast("string")
    name = F.coalesce(over("video_name"), N.stem("_p"))
    return rows.select(N.resolve("_p", base).alias("input_path"), name.alias("video_name"),
                       F.coalesce(over("output_h5"), over("point_cloud_h5"), F.concat(F.lit(out_dir.rstrip("/") + "/"), name, F.lit(suffix + ".parquet"))).alias("output_path"))


def read_batch_items(spark: SparkSession, path: str, base: str, out_dir: str, header: bool = True) -> DataFrame:
    """CSV with a header, or one path per row."""
    if header:
        return batch_items(spark.read.option("header", True).csv(path), base, out_dir)
    return batch_items(spark.read.text(path).withColumnRenamed("value", "path"), base, out_dir)


def list_files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True, max_files: int | None = None) -> DataFrame:
    """Sorted paths below a folder; contents are never read.  A folder without a match is an error."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    out = required(r.select("path"), f"no file matches {glob}").orderBy("path")
    return out.limit(max_files) if max_files is not None else out


def point_table(df: DataFrame, labels: bool = True) -> DataFrame:
    """Check required columns and add the optional ones as typed nulls."""
    need = {**SC.POINT_REQUIRED, **(SC.POINT_LABELS if labels else {})}
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    opt = {**({} if labels else SC.POINT_LABELS), **SC.POINT_OPTIONAL}
    cols = [F.col(c).cast(t).alias(c) for c, t in need.items()]
    cols += [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in opt.items()]
    return df.select(*cols)


def read_points(spark: SparkSession, path: str, labels: bool = True) -> DataFrame:
    return point_table(spark.read.parquet(path), labels)


def points_with_frames(points: DataFrame, frames: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Points with their frame's index and stated counts."""
    return lookup(points, frames.select("video_name", "frame_order", "frame_index", *counts), ["video_name", "frame_order"], F.col("point_index"))


def pose_table(poses: DataFrame, geometry: str) -> DataFrame:
    """Poses of one geometry; the other column is never read."""
    column = {"prior": "pose_prior", "corr": "pose_corr"}[geometry]
    return poses.select("video_name", "frame_order", F.col(column).alias("pose"))


# Words for true, allowed splits, allowed names.
TRUE_WORDS = ["1", "true", "yes", "on"]
FALSE_WORDS = ["0", "false", "no", "off"]
SPLITS = ["train", "validation", "test", "smoke"]
NAME_RULE = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"


def manifest(table: DataFrame, base: str) -> DataFrame:
    """Typed manifest rows with the first problem of each, NULL if none; duplicates are problems too.

    A manifest without rows, or without an enabled one, is an error.  A given
    ``annotation_root`` is resolved like the source and must not be empty.
    """
    missing = [f.name for f in SC.MANIFEST.fields if f.name not in table.columns and f.name != "notes"]
    if missing:
        raise ValueError(f"missing columns {missing}")
    word = F.lower(F.trim("enabled"))
    rows = table.withColumns({"enabled": F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False), "video_name": F.trim("video_name"),
                              "split": F.lower(F.trim("split")), "source_path": N.resolve(F.trim("source_path"), base)})
    rows = required(rows, "the manifest has no enabled row", F.col("enabled"))
    root = F.lit(False)
    if "annotation_root" in table.columns:
        root = F.coalesce(F.trim("annotation_root"), F.lit("")) == ""
        rows = rows.withColumn("annotation_root", F.when(~root, N.resolve(F.trim("annotation_root"), base)))
        root = F.col("annotation_root").isNull()
    twice = lambda c: rows.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(c, F.lit(True).alias(f"_dup_{c}"))
    rows = rows.join(twice("video_name"), "video_name", "left").join(twice("source_path"), "source_path", "left")
    problem = (F.when(~F.col("video_name").rlike(NAME_RULE), "bad_name").when(~F.col("split").isin(SPLITS), "bad_split").when(F.col("enabled").isNull(), "bad_enabled").when(root, "no_annotation_root")
               .when(F.col("_dup_video_name"), "duplicate_video").when(F.col("_dup_source_path"), "duplicate_source"))
    return rows.withColumn("problem", problem).drop("_dup_video_name", "_dup_source_path")


def read_manifest(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Manifest CSV, read as text and typed here."""
    return manifest(spark.read.option("header", True).csv(path), base)


def build_manifest(files: DataFrame, annotations: DataFrame, suffix: str, split: str) -> DataFrame:
    """Manifest from source files and annotation counts: a file is enabled if it has annotations."""
    st = N.stem("path")
    f = files.filter(st.endswith(suffix)).select(F.substring(st, F.lit(1), F.length(st) - len(suffix)).alias("video_name"), F.col("path").alias("source_path"))
    dup = f.groupBy("video_name").agg(F.count(F.lit(1)).alias("_n"), F.min("source_path").alias("source_path"))
    one = F.when(F.col("_n") == 1, F.col("source_path")).otherwise(F.raise_error(F.concat(F.lit("duplicate video "), "video_name")))
    n = annotations.groupBy("video_name").agg(F.count(F.lit(1)).alias("annotations"))
    out = dup.select("video_name", one.alias("source_path")).join(n, "video_name", "left").fillna(0, ["annotations"])
    return out.select("video_name", "source_path", F.lit(split).alias("split"), (F.col("annotations") > 0).alias("enabled"),
                      F.concat(F.lit("annotations="), F.col("annotations").cast("string")).alias("notes"))


def audit_manifest(rows: DataFrame, frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Status of each manifest row with the first failing reason and the matched counts."""
    f = frames.groupBy("video_name").agg(F.count(F.lit(1)).alias("frames"))
    b = boxes.join(frames.select("video_name", "frame_order"), ["video_name", "frame_order"], "left_semi").groupBy("video_name").agg(
        F.count_distinct("frame_order").alias("annotated_frames"), F.count(F.lit(1)).alias("boxes"))
    out = rows.join(f, "video_name", "left").join(b, "video_name", "left").fillna(0, ["frames", "annotated_frames", "boxes"])
    reason = F.when(F.col("frames") == 0, "no_frames").when(F.col("annotated_frames") == 0, "no_annotation").when(F.col("boxes") < 2, "too_few_boxes")
    return out.withColumn("reason", F.when(F.col("enabled"), reason)).withColumn(
        "status", F.when(~F.col("enabled"), "disabled").when(F.col("reason").isNotNull(), "failed").otherwise("ok"))


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("split", "status").agg(F.count(F.lit(1)).alias("videos"), F.sum("boxes").alias("boxes"))


def concat_metadata(tables: Sequence[DataFrame], split: str = "all", limit: int | None = None, key: str = "sweep_id", order: str | None = None,
                    frames: str | None = None) -> DataFrame:
    """Metadata tables as one, filtered by split, cut in order, with an error on a repeated sweep.

    ``order`` is the line of a row in its table: the limit then keeps the first
    rows table by table, else the first by key.  ``frames`` names the number of
    frames a sweep was found to have; sweeps that could not be read (-1 or
    null) are left out at the end, after limit and check.
    """
    out = tables[0].withColumn("_table", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.withColumn("_table", F.lit(i)), allowMissingColumns=True)
    if split != "all":
        out = out.filter(F.col("split") == split)
    if limit is not None:
        out = out.orderBy(*(["_table", order] if order else [key])).limit(limit)
    n = out.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    bad = F.raise_error(F.concat(F.lit("repeated sweep "), F.col(key).cast("string"))).cast("boolean")
    once = out.join(n, key).filter(F.when(F.col("_n") > 1, bad).otherwise(F.lit(True))).drop("_n", "_table")
    return once if frames is None else once.filter(F.col(frames) >= 0)


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``file, sha256`` of small files (configurations) below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def duplicate_stems(paths: DataFrame) -> DataFrame:
    """Stems shared by several inputs: how many, and the first and last of them."""
    p = paths.select(N.stem("path").alias("stem"), "path")
    return p.groupBy("stem").agg(F.count(F.lit(1)).alias("inputs"), F.min("path").alias("first_path"), F.max("path").alias("last_path")).filter("inputs > 1")


def match_artifacts(videos: DataFrame, summary: DataFrame, files: DataFrame, suffix: str) -> DataFrame:
    """Artifact of each video: summary row, else exact file name, else unique path that contains the name."""
    tiers = summary.select("video_name", "path", F.lit(1).alias("tier"))
    exact = videos.join(files.withColumn("_s", N.stem("path")), F.concat("video_name", F.lit(suffix)) == F.col("_s")).select("video_name", "path", F.lit(2).alias("tier"))
    inside = contains_join(files.select("path").distinct(), "path", "path", videos, "video_name").select("video_name", "path", F.lit(3).alias("tier"))
    found = tiers.join(videos, "video_name", "left_semi").unionByName(exact).unionByName(inside)
    best = found.groupBy("video_name", "tier").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("path"))
    best = best.groupBy("video_name").agg(F.min_by(F.struct("tier", "_n", "path"), "tier").alias("b"))
    return videos.join(best, "video_name", "left").select("video_name", F.col("b.tier").alias("tier"), F.when(F.col("b._n") == 1, F.col("b.path")).alias("path"),
                                                          F.when(F.col("b").isNull(), "missing").when(F.col("b._n") > 1, "ambiguous").otherwise("ok").alias("status"))


def numbered_ids(df: DataFrame, key: str, bucket) -> DataFrame:
    """Row number within each split as id."""
    return with_position(df, ["split"], [key], bucket, "id")


def json_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Parsed records of numbered text lines (line, value); a bad line stops the query with its number."""
    kept = lines.filter(F.trim("value") != "")
    parsed = kept.withColumn("_j", F.try_parse_json("value"))
    bad = F.raise_error(F.concat(F.lit("invalid JSON at line "), F.col("line").cast("string"))).cast("string")
    text = F.when(F.col("_j").isNull(), bad).otherwise(F.col("value"))
    return parsed.withColumn("_r", F.from_json(text, schema)).select("line", "_r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value``: text lines with their number in their file, from 1.

    A large file is read in blocks by many tasks.  Each task counts the lines
    of its blocks as they come; the lines of earlier blocks of a file follow
    from one row per block.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for b in batches:
            numbers = np.zeros(b.num_rows, np.int64)
            for i, where in enumerate(zip(b["file"].to_pylist(), b["_block"].to_pylist())):
                at, n = where, n + 1 if where == at else 1
                numbers[i] = n
            yield pa.record_batch({**{c: b[c] for c in b.schema.names}, "_line": pa.array(numbers)})

    counted = lines.mapInArrow(count, "file string, _block bigint, value string, _line bigint")
    before = W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = counted.groupBy("file", "_block").agg(F.max("_line").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return counted.join(blocks, ["file", "_block"]).select("file", (F.col("_line") + F.col("_before")).alias("line"), "value")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``file, line`` and the fields of JSON records, one per line; a bad line stops the query with its file and number."""
    kept = numbered_lines(spark, path).filter(F.trim("value") != "")
    where = F.concat(F.lit("invalid JSON at "), "file", F.lit(", line "), F.col("line").cast("string"))
    text = F.when(F.try_parse_json("value").isNull(), F.raise_error(where).cast("string")).otherwise(F.col("value"))
    return kept.withColumn("_r", F.from_json(text, schema)).select("file", "line", "_r.*")
