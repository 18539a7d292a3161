"""Queries over sources, sinks and sharing; files are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F, types as T

from framelake.functions import geometry as G
from framelake.operators import compare as C, metrics as M, sharing as SH, windows as WI
from framelake.operators.layout import lookup
from framelake.plans import views as V
from framelake.plans.boxqueries import rounded
from framelake.plans.posequeries import CAL, NAMES, mcols, mul, rnd
from framelake.plans.registry import query
from framelake.plans.voting import scored_windows
from framelake.session import scratch_path
from framelake.sources import readers as RD, sinks as SK
from framelake.sources.commits import CommittedTable

LINES_SQL = """ln AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '   ' WHEN 1 THEN '# note ' || page_id WHEN 2 THEN ' scans/clip_' || page_id || '.h5 ' ELSE '/data/clip_' || page_id % 100 || '.h5' END AS value FROM pages)"""


def lines(spark, d):
    i = F.col("page_id")
    return V.table(spark, d, "pages").select(i, F.when(i % 5 == 0, "   ").when(i % 5 == 1, F.concat(F.lit("# note "), i)).when(
        i % 5 == 2, F.concat(F.lit(" scans/clip_"), i, F.lit(".h5 "))).otherwise(F.concat(F.lit("/data/clip_"), i % 100, F.lit(".h5"))).alias("value"))


@query("s01_path_list", f"WITH {LINES_SQL} SELECT CASE WHEN starts_with(trim(value), '/') THEN trim(value) ELSE '/lists/' || trim(value) END AS path FROM ln WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#')")
def s01(spark, d):
    at = scratch_path(spark, "list")
    lines(spark, d).select("value").write.text(at)
    return RD.read_path_list(spark, at, "/lists")


@query("s22_duplicate_stems", f"""
  WITH {LINES_SQL}, p AS (SELECT trim(value) AS path FROM ln WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#')), s AS (SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM p)
  SELECT stem, count(*) AS inputs, min(path) AS first_path, max(path) AS last_path FROM s GROUP BY 1 HAVING count(*) > 1""")
def s22(spark, d):
    p = lines(spark, d).select(F.trim("value").alias("path")).filter("path <> '' AND NOT path LIKE '#%'")
    return RD.duplicate_stems(p)


@query("s02_batch_items", """
  SELECT '/in/clips/p' || page_id || '.h5' AS input_path, CASE WHEN page_id % 3 = 0 THEN 'named_' || page_id ELSE 'p' || page_id END AS video_name,
    CASE WHEN page_id % 4 = 0 THEN '/given/' || page_id ELSE '/out/' || CASE WHEN page_id % 3 = 0 THEN 'named_' || page_id ELSE 'p' || page_id END || '_points.parquet' END AS output_path FROM pages""")
def s02(spark, d):
    i, at = F.col("page_id"), scratch_path(spark, "items")
    V.table(spark, d, "pages").select(F.lit("x").alias("other"), F.concat(F.lit("clips/p"), i, F.lit(".h5")).alias("input_h5"), F.when(i % 3 == 0, F.concat(F.lit("named_"), i)).otherwise(" ").alias("video_name"),
                                      F.when(i % 4 == 0, F.concat(F.lit("/given/"), i)).alias("output_h5")).write.option("header", True).csv(at)
    return RD.read_batch_items(spark, at, "/in", "/out")


@query("s03_directory", "SELECT 'c_nationkey=' || c_nationkey AS folder, 1::BIGINT AS files FROM customer GROUP BY c_nationkey")
def s03(spark, d):
    at = scratch_path(spark, "dir")
    V.table(spark, d, "customer").select("c_name", "c_nationkey").repartition("c_nationkey").write.partitionBy("c_nationkey").text(at)
    return RD.list_files(spark, at, "*.txt").groupBy(F.regexp_extract("path", r"/(c_nationkey=\d+)/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"))


POINT_SQL = "video_name, count(*) AS points, count(*) FILTER (point_label = 1) AS positive, count(*) FILTER (source_flags & 1 <> 0) AS flagged"


@query("s04_annotated_points", f"SELECT {POINT_SQL}, count(*) AS without_frame_index FROM points GROUP BY 1", "points")
def s04(spark, d):
    at = scratch_path(spark, "points")
    V.points(spark, d).write.parquet(at)
    p = RD.read_points(spark, at)
    return p.groupBy("video_name").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("point_label") == 1).alias("positive"),
                                       F.count_if(F.col("source_flags").bitwiseAND(F.lit(1)) != 0).alias("flagged"), F.count_if(F.col("frame_index").isNull()).alias("without_frame_index"))


@query("s05_unannotated_points", "SELECT video_name, count(*) AS points, count(*) AS unlabelled FROM points GROUP BY 1", "points")
def s05(spark, d):
    p = RD.point_table(V.points(spark, d).drop("point_label", "valid_mask"), labels=False)
    return p.groupBy("video_name").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("point_label").isNull()).alias("unlabelled"))


@query("s06_points_with_frames", """
  WITH f AS (SELECT video_name, frame_order, min(part_key) AS frame_index, count(*) AS num_points FROM points GROUP BY 1, 2)
  SELECT p.video_name, p.point_index, f.frame_index, f.num_points FROM points p JOIN f USING (video_name, frame_order)""", "points")
def s06(spark, d):
    p = V.points(spark, d)
    f = p.groupBy("video_name", "frame_order").agg(F.min("part_key").alias("frame_index"), F.count(F.lit(1)).alias("num_points"))
    return RD.points_with_frames(p, f, ["num_points"]).select("video_name", "point_index", "frame_index", "num_points")


@query("s07_pose_source", "SELECT 'corr' AS kind, video_name, frame_order, round(bm03, 6) + 0.0 AS x FROM poses UNION ALL SELECT 'prior', video_name, frame_order, round(am03, 6) + 0.0 FROM poses", "poses")
def s07(spark, d):
    p = V.poses(spark, d).withColumnsRenamed({"pose": "pose_prior", "pred": "pose_corr"})
    one = lambda g: RD.pose_table(p, g).select(F.lit(g).alias("kind"), "video_name", "frame_order", (F.round(F.col("pose").getItem(3), 6) + 0.0).alias("x"))
    return one("corr").unionByName(one("prior"))


MANIFEST_SQL = """mf AS (SELECT CASE WHEN s_suppkey % 11 = 0 THEN ' bad name ' ELSE 'video_' || CASE WHEN s_suppkey % 13 = 1 THEN 1 ELSE s_suppkey END END AS video_name, 'in/' || s_suppkey || '.h5' AS source_path,
    CASE WHEN s_suppkey % 17 = 2 THEN 'holdout' WHEN s_suppkey % 3 = 0 THEN 'Train' ELSE 'test' END AS split, CASE s_suppkey % 5 WHEN 0 THEN 'YES' WHEN 1 THEN '0' WHEN 2 THEN 'on' WHEN 3 THEN 'False' ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'maybe' ELSE '1' END END AS enabled FROM supplier)"""


def manifest_rows(spark, d):
    k = F.col("s_suppkey")
    return V.table(spark, d, "supplier").select(
        F.when(k % 11 == 0, " bad name ").otherwise(F.concat(F.lit("video_"), F.when(k % 13 == 1, 1).otherwise(k))).alias("video_name"), F.concat(F.lit("in/"), k, F.lit(".h5")).alias("source_path"),
        F.lit("ann").alias("annotation_root"), F.when(k % 17 == 2, "holdout").when(k % 3 == 0, "Train").otherwise("test").alias("split"),
        F.when(k % 5 == 0, "YES").when(k % 5 == 1, "0").when(k % 5 == 2, "on").when(k % 5 == 3, "False").when(k % 2 == 0, "maybe").otherwise("1").alias("enabled"), F.lit("").alias("notes"))


@query("s08_sweep_manifest", f"""
  WITH {MANIFEST_SQL}, t AS (SELECT trim(video_name) AS video_name, '/base/' || source_path AS source_path, lower(split) AS split, CASE WHEN lower(enabled) IN ('1', 'true', 'yes', 'on') THEN true WHEN lower(enabled) IN ('0', 'false', 'no', 'off') THEN false END AS enabled FROM mf)
  SELECT *, CASE WHEN contains(video_name, ' ') THEN 'bad_name' WHEN split NOT IN ('train', 'validation', 'test', 'smoke') THEN 'bad_split' WHEN enabled IS NULL THEN 'bad_enabled'
    WHEN count(*) OVER (PARTITION BY video_name) > 1 THEN 'duplicate_video' END AS problem FROM t""")
def s08(spark, d):
    at = scratch_path(spark, "manifest")
    manifest_rows(spark, d).write.option("header", True).csv(at)
    return RD.read_manifest(spark, at, "/base").select("video_name", "source_path", "split", "enabled", "problem")


@query("s09_manifest_builder", """
  WITH n AS (SELECT video_name, count(*) AS n FROM boxes WHERE valid GROUP BY 1)
  SELECT 'v' || s_suppkey AS video_name, '/src/v' || s_suppkey || '_points.h5' AS source_path, 'train' AS split, coalesce(n, 0) > 0 AS enabled, 'annotations=' || coalesce(n, 0) AS notes FROM supplier LEFT JOIN n ON n.video_name = s_suppkey""", "boxes")
def s09(spark, d):
    files = V.table(spark, d, "supplier").select(F.concat(F.lit("/src/v"), "s_suppkey", F.lit("_points.h5")).alias("path"))
    ann = V.boxes(spark, d).filter("valid").select(F.concat(F.lit("v"), "video_name").alias("video_name"))
    return RD.build_manifest(files, ann, "_points", "train")


AUDIT_SQL = """f AS (SELECT DISTINCT video_name, frame_order FROM points), fc AS (SELECT video_name, count(*) AS frames FROM f GROUP BY 1),
  bc AS (SELECT video_name, count(DISTINCT frame_order) AS annotated_frames, count(*) AS boxes FROM boxes SEMI JOIN f USING (video_name, frame_order) GROUP BY 1),
  r AS (SELECT s.video_name, s.split, s.video_name % 7 <> 0 AS enabled, coalesce(frames, 0) AS frames, coalesce(annotated_frames, 0) AS annotated_frames, coalesce(boxes, 0) AS boxes FROM video_split s LEFT JOIN fc USING (video_name) LEFT JOIN bc USING (video_name)),
  au AS (SELECT *, CASE WHEN enabled THEN CASE WHEN frames = 0 THEN 'no_frames' WHEN annotated_frames = 0 THEN 'no_annotation' WHEN boxes < 2 THEN 'too_few_boxes' END END AS reason FROM r),
  st AS (SELECT *, CASE WHEN NOT enabled THEN 'disabled' WHEN reason IS NOT NULL THEN 'failed' ELSE 'ok' END AS status FROM au)"""


def audit(spark, d):
    rows = V.video_split(spark, d).withColumn("enabled", F.col("video_name") % 7 != 0)
    f = V.points(spark, d).select("video_name", "frame_order").distinct()
    return RD.audit_manifest(rows, f, V.boxes(spark, d))


@query("s10_manifest_audit", f"WITH {AUDIT_SQL} SELECT * FROM st", "points boxes video_split")
def s10(spark, d):
    return audit(spark, d)


@query("s10_audit_summary", f"WITH {AUDIT_SQL} SELECT split, status, count(*) AS videos, CAST(sum(boxes) AS BIGINT) AS boxes FROM st GROUP BY 1, 2", "points boxes video_split")
def s10_summary(spark, d):
    return RD.audit_summary(audit(spark, d))


@query("s11_collect_status", "SELECT '/a/' || o_orderkey AS path, 'o' || o_orderkey AS name, CASE WHEN l.k IS NOT NULL THEN 'skipped_exists' ELSE 'copied' END AS status FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 30) l ON k = o_orderkey")
def s11(spark, d):
    src = V.table(spark, d, "orders").select(F.concat(F.lit("/a/"), "o_orderkey").alias("path"), F.concat(F.lit("o"), "o_orderkey").alias("name"))
    return SK.collect_status(src, V.table(spark, d, "lineitem").filter("l_quantity > 30").select(F.concat(F.lit("o"), "l_orderkey").alias("name")))


@query("s12_incremental_run", """
  SELECT o_orderkey AS item, CASE WHEN l.k IS NOT NULL THEN 'skipped' WHEN o_totalprice > 100000 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN l.k IS NULL AND o_totalprice <= 100000 THEN 'price too low: ' || o_orderpriority END AS error
  FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 40) l ON k = o_orderkey""")
def s12(spark, d):
    items = V.table(spark, d, "orders").withColumnRenamed("o_orderkey", "item")
    done = V.table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("item"))
    return SK.incremental(items, done, "item", F.col("o_totalprice") > 100000, F.concat(F.lit("price too low: "), "o_orderpriority")).select("item", "status", "error")


@query("s12_incremental_append", "SELECT o_orderkey AS item, o_custkey AS result FROM orders")
def s12_append(spark, d):
    """Two runs over the same items: the second only adds what the first left out."""
    at = scratch_path(spark, "results")
    items = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("result"))
    table, third = CommittedTable(spark, at), items.filter("result % 3 = 0")
    for run, some in (("first", third), ("first", third), ("second", items), ("second", items)):  # a repeated run changes nothing
        SK.run_incremental(some, "item", lambda x: x, table, items.schema, run)
    return table.read(items.schema)


@query("s13_ragged_csv", "SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(count(*) AS VARCHAR) AS orders, NULL::VARCHAR AS lines FROM orders GROUP BY o_custkey UNION ALL SELECT CAST(l_suppkey AS VARCHAR), NULL, CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY l_suppkey")
def s13(spark, d):
    at = scratch_path(spark, "csv")
    a = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("orders"))
    b = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("lines"))
    SK.write_ragged_csv([a, b], at)
    return spark.read.option("header", True).csv(at)


@query("s14_prediction_sink", "SELECT checkpoint, split, video_name, count(*) AS points, CAST(sum(vote_count) AS BIGINT) AS votes, CAST(sum(pred_label) AS BIGINT) AS positive FROM votes JOIN video_split USING (video_name) GROUP BY 1, 2, 3", "votes video_split")
def s14(spark, d):
    at = scratch_path(spark, "predictions")
    # One shuffle puts points where their windows, votes, splits and files are made.
    v = M.vote(scored_windows(spark, d, keep="part"), ["checkpoint", "video_name", "point_index", "part"], ["point_label", "valid_mask"])
    v = lookup(v, V.video_split(spark, d), ["video_name"], F.col("point_index"), "inner", keep="part").drop("valid_mask")
    p = V.points(spark, d)
    SK.write_predictions(v, WI.window_summary(WI.into_windows(p, 12, 6), WI.frame_windows(p, 12, 6)), at, part="part")
    return spark.read.parquet(f"{at}/predictions").groupBy("checkpoint", "split", "video_name").agg(
        F.count(F.lit(1)).alias("points"), F.sum("vote_count").alias("votes"), F.sum("pred_label").cast("bigint").alias("positive"))


@query("s15_metrics_jsonl", "SELECT event_id AS line, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s15(spark, d):
    rows = V.table(spark, d, "events").select(F.col("event_id").alias("line"), F.col("props").alias("value"))
    return RD.json_lines(rows, T.StructType([T.StructField("k", T.LongType())]))


@query("s15_jsonl_append", "SELECT event_id, user_id, value, true AS in_order FROM events")
def s15_append(spark, d):
    """Two appends of files sorted by event; the line numbers of each file count its events in that order."""
    at = scratch_path(spark, "jsonl")
    e = V.table(spark, d, "events").select("event_id", "user_id", "value")
    for part in (0, 1):
        SK.append_json_lines(e.filter(F.col("event_id") % 2 == part).repartition(4, "event_id").sortWithinPartitions("event_id"), at)
    back = RD.read_json_lines(spark, at, e.schema)
    rank = F.row_number().over(W.partitionBy("file").orderBy("event_id"))
    return back.select("event_id", "user_id", "value", (F.col("line") == rank).alias("in_order"))


@query("s16_summary_file", "SELECT count(*) AS videos, sum(s_nationkey)::BIGINT AS seeds, min(s_name) AS first_video FROM supplier")
def s16_file(spark, d):
    at = scratch_path(spark, "summary")
    s = V.table(spark, d, "supplier")
    SK.write_summary(s.agg(F.count(F.lit(1)).alias("videos"), F.sum("s_nationkey").cast("long").alias("seeds"), F.min("s_name").alias("first_video")), at)
    return spark.read.schema("videos bigint, seeds bigint, first_video string").json(at)


@query("s21_split_files", "SELECT split, row_number() OVER (PARTITION BY split ORDER BY video_name) - 1 AS id FROM video_split", "video_split")
def s21_files(spark, d):
    at = scratch_path(spark, "ids")
    SK.write_id_lists(RD.numbered_ids(V.video_split(spark, d), "video_name", F.floor(F.col("video_name") / 65_536)).select("split", "id"), at)
    lines = RD.numbered_lines(spark, at)
    split = F.regexp_extract("file", "split=([^/]+)/", 1)
    first = lines.groupBy("file").agg(F.min(F.col("value").cast("long")).alias("first"))
    # inside a file, ids go up by one from line to line
    return lines.join(first, "file").select(split.alias("split"), (F.col("first") + F.col("line") - 1).alias("id"))


@query("s18_artifact_match", """
  WITH v AS (SELECT 'clip' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS video_name, s_suppkey AS k FROM supplier),
  fl AS (SELECT CASE c_custkey % 3 WHEN 0 THEN '/art/clip' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '_ref.csv' WHEN 1 THEN '/art/x/clip' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '/data.csv' ELSE '/art/misc/' || c_custkey || '.csv' END AS path FROM customer
    UNION ALL SELECT '/copy/xclip' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || 'b.csv' FROM customer WHERE c_custkey % 6 = 1),
  t AS (SELECT video_name, '/sum/' || k AS path, 1 AS tier FROM v WHERE k % 10 = 0 UNION ALL SELECT video_name, path, 2 FROM v JOIN fl ON regexp_extract(path, '([^/]*)$', 1) = video_name || '_ref.csv' UNION ALL SELECT video_name, path, 3 FROM v JOIN fl ON contains(path, video_name)),
  b AS (SELECT video_name, min(tier) AS tier FROM t GROUP BY 1), g AS (SELECT video_name, tier, count(*) AS n, min(path) AS path FROM t JOIN b USING (video_name, tier) GROUP BY 1, 2)
  SELECT video_name, tier, CASE WHEN n = 1 THEN path END AS path, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM v LEFT JOIN g USING (video_name)""")
def s18(spark, d):
    name = lambda c: F.concat(F.lit("clip"), F.format_string("%06d", F.col(c)))
    v = V.table(spark, d, "supplier").select(name("s_suppkey").alias("video_name"), "s_suppkey")
    c = V.table(spark, d, "customer")
    k = F.col("c_custkey")
    files = c.select(F.when(k % 3 == 0, F.concat(F.lit("/art/"), name("c_custkey"), F.lit("_ref.csv"))).when(k % 3 == 1, F.concat(F.lit("/art/x/"), name("c_custkey"), F.lit("/data.csv")))
                     .otherwise(F.concat(F.lit("/art/misc/"), k, F.lit(".csv"))).alias("path"))
    files = files.union(c.filter(k % 6 == 1).select(F.concat(F.lit("/copy/x"), name("c_custkey"), F.lit("b.csv"))))
    summary = v.filter("s_suppkey % 10 = 0").select("video_name", F.concat(F.lit("/sum/"), "s_suppkey").alias("path"))
    return RD.match_artifacts(v.select("video_name"), summary, files, "_ref")


@query("s19_metadata_concat", "SELECT s_suppkey AS sweep_id, 'train' AS split, NULL::VARCHAR AS site FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'train', s_name FROM supplier WHERE s_suppkey % 4 = 1")
def s19(spark, d):
    k = F.col("s_suppkey")
    s = V.table(spark, d, "supplier")
    a = s.filter(k % 2 == 0).select(k.alias("sweep_id"), F.lit("train").alias("split"))
    b = s.filter(k % 2 == 1).select(k.alias("sweep_id"), F.when(k % 4 == 1, "train").otherwise("test").alias("split"), F.col("s_name").alias("site"))
    return RD.concat_metadata([a, b], "train")


@query("s19_metadata_files", """
  WITH m AS (SELECT s_suppkey AS sweep_id, CASE WHEN s_suppkey % 4 = 1 THEN 'test' ELSE 'train' END AS split, s_suppkey % 2 AS t, 1000000 - s_suppkey AS line, CASE WHEN s_nationkey % 6 = 0 THEN -1 WHEN s_nationkey % 6 = 1 THEN NULL ELSE s_nationkey END AS num_frames FROM supplier),
  r AS (SELECT *, row_number() OVER (ORDER BY t, line) AS r FROM m WHERE split = 'train')
  SELECT sweep_id, num_frames FROM r WHERE r <= 40 AND num_frames >= 0""")
def s19_files(spark, d):
    """Two tables in the order of their lines, cut to a number of scans; unreadable ones among those go afterwards."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    s = V.table(spark, d, "supplier").select(
        k.alias("sweep_id"), F.when(k % 4 == 1, "test").otherwise("train").alias("split"), (F.lit(1_000_000) - k).alias("line"), F.when(n % 6 == 0, -1).when(n % 6 != 1, n).alias("num_frames"))
    tables = [s.filter(F.col("sweep_id") % 2 == t) for t in (0, 1)]
    return RD.concat_metadata(tables, "train", 40, order="line", frames="num_frames").select("sweep_id", "num_frames")


@query("p23_file_hashes", "SELECT n_nationkey, sha256(n_name || ',' || n_regionkey || chr(10)) AS sha256 FROM nation")
def p23_files(spark, d):
    """A configuration file per nation, hashed as it lies on disk."""
    at = scratch_path(spark, "configs")
    V.table(spark, d, "nation").select("n_nationkey", F.concat_ws(",", "n_name", "n_regionkey").alias("value")).write.partitionBy("n_nationkey").text(at)
    files = RD.file_hashes(spark, at, "part-*")
    return files.select(F.regexp_extract("file", "n_nationkey=([0-9]+)/", 1).cast(V.table(spark, d, "nation").schema["n_nationkey"].dataType).alias("n_nationkey"), "sha256")


CONV = {f"k{r}{c}": CAL[4 * r + c] for r in range(3) for c in range(4)}


@query("s20_sweep_conversion", f"WITH c AS (SELECT *, {', '.join(f'{v}::DOUBLE AS {n}' for n, v in CONV.items())} FROM poses), m AS (SELECT *, {mul('am', 'k', 'o')} FROM c) SELECT video_name, frame_order, {rnd('o')} FROM m", "poses")
def s20(spark, d):
    p = V.poses(spark, d).withColumn("out", G.product("pose", G.literal(CAL)))
    return p.select("video_name", "frame_order", *mcols("out"))


@query("s20_conversion_check", "SELECT count(*) AS compared, 0::BIGINT AS one_sided, 'x' AS column, 0::BIGINT AS mismatches FROM poses", "poses")
def s20_check(spark, d):
    p = V.poses(spark, d)
    conv = p.select("video_name", "frame_order", G.product("pose", G.literal(CAL)).getItem(3).alias("x"))
    again = p.select("video_name", "frame_order", G.move("pose", F.lit(CAL[3]), F.lit(CAL[7]))[0].alias("x"))
    return C.tolerance_compare(conv, again, ["video_name", "frame_order"], ["x"])


@query("s20_planted_differences", """
  SELECT count(*) FILTER (frame_order NOT IN (5, 6)) AS compared, count(*) FILTER (frame_order IN (5, 6)) AS one_sided, 'x' AS column, count(*) FILTER (frame_order = 3) AS mismatches FROM poses""", "poses")
def s20_planted(spark, d):
    """One frame is off, one is missing on either side."""
    p = V.poses(spark, d)
    conv = p.filter("frame_order <> 5").select("video_name", "frame_order", (G.product("pose", G.literal(CAL)).getItem(3) + F.when(F.col("frame_order") == 3, 1.0).otherwise(0.0)).alias("x"))
    again = p.filter("frame_order <> 6").select("video_name", "frame_order", G.move("pose", F.lit(CAL[3]), F.lit(CAL[7]))[0].alias("x"))
    return C.tolerance_compare(conv, again, ["video_name", "frame_order"], ["x"])


@query("s21_split_ids", "SELECT split, row_number() OVER (PARTITION BY split ORDER BY video_name) - 1 AS id, video_name FROM video_split", "video_split")
def s21(spark, d):
    return RD.numbered_ids(V.video_split(spark, d), "video_name", F.floor(F.col("video_name") / 65_536)).select("split", "id", "video_name")


@query("j07_feature_cache", "SELECT f.video_name, f.frame_order, f.value, c.n AS feature FROM frames f LEFT JOIN (SELECT user_id, count(*) AS n, min(event_id) AS e FROM events GROUP BY user_id) c ON c.user_id = f.video_name AND f.frame_order >= 4 WHERE f.frame_order BETWEEN 4 AND 19", "frames")
def j07(spark, d):
    """Cached features joined on a slice of each sequence; the slice is filtered on both sides."""
    f = V.frames(spark, d).filter("frame_order BETWEEN 4 AND 19").select("video_name", "frame_order", "value")
    n = V.table(spark, d, "events").groupBy(F.col("user_id").alias("video_name")).agg(F.count(F.lit(1)).alias("feature"))
    cache = V.frames(spark, d).select("video_name", "frame_order").join(n, "video_name").filter("frame_order BETWEEN 4 AND 19")
    return f.join(cache, ["video_name", "frame_order"], "left")


ALIAS_SQL = """sel AS (SELECT s_suppkey AS video_name, CASE s_suppkey % 3 WHEN 0 THEN 'fixed' WHEN 1 THEN 'random' ELSE 'validation' END AS role, CAST(s_acctbal AS BIGINT) AS place FROM supplier),
  al AS (SELECT video_name, role, CASE role WHEN 'fixed' THEN 'train_sanity_fixed_' WHEN 'random' THEN 'train_sanity_random_' ELSE 'validation_' END || lpad(CAST(r AS VARCHAR), CAST(greatest(3, length(CAST(r AS VARCHAR))) AS INTEGER), '0') AS alias
    FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY place, video_name) AS r FROM sel))"""


def alias_map(spark, d):
    k = F.col("s_suppkey")
    sel = V.table(spark, d, "supplier").select(k.alias("video_name"), F.when(k % 3 == 0, "fixed").when(k % 3 == 1, "random").otherwise("validation").alias("role"), F.rint("s_acctbal").cast("bigint").alias("place"))
    return SH.aliases(sel)


@query("x01_aliases", f"WITH {ALIAS_SQL} SELECT * FROM al")
def x01(spark, d):
    return alias_map(spark, d)


def metric_rows(spark, d):
    m = M.confusion(V.points(spark, d).withColumn("pred_label", (F.col("intensity") >= 128).cast("int")), ["video_name"], prob=None)
    return m.select("video_name", F.concat(F.lit("/data/h5/"), "video_name").alias("h5_path"), F.lit("/runs/a/best.pt").alias("checkpoint"), "tp", "fp")


REWRITE_SQL = f"{ALIAS_SQL}, rw AS (SELECT alias AS video_name, alias || '.h5' AS h5_path, 'best.pt' AS checkpoint, count(*) FILTER (valid_mask AND point_label = 1 AND intensity >= 128) AS tp, count(*) FILTER (valid_mask AND point_label = 0 AND intensity >= 128) AS fp FROM points JOIN al USING (video_name) GROUP BY 1)"


@query("x02_rewritten_rows", f"WITH {REWRITE_SQL} SELECT * FROM rw", "points")
def x02(spark, d):
    return SH.rewrite(metric_rows(spark, d), alias_map(spark, d))


@query("x03_sanitized_json", """
  SELECT event_id, '{"note": "clip REDACTED_VIDEO ok", "kind": "' || event_type || '", "n": ' || user_id || ', "out_dir": "REDACTED_PATH", "deep": {"files": ["REDACTED_PATH", "REDACTED_PATH"], "list": ["a", "REDACTED_PATH", {"x": null}]}}' AS json FROM events""")
def x03(spark, d):
    text = F.concat(F.lit('{"note": "clip 20240101_120000_'), F.col("event_id"), F.lit(' ok", "kind": "'), F.col("event_type"), F.lit('", "n": '), F.col("user_id"),
                    F.lit(', "out_dir": "runs/x", "deep": {"files": ["a.txt", "/b"], "list": ["a", "/abs/c", {"x": null}]}}'))
    return V.table(spark, d, "events").select("event_id", SH.sanitize_json(text).alias("json"))


TEXTS_SQL = """tx AS (SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 50 = 0 THEN text || ' video 20240101_120000_' || doc_id WHEN doc_id % 50 = 1 THEN text || ' see /home/u/' || doc_id WHEN doc_id % 50 = 2 THEN text || ' of xscan_' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || 'y' ELSE text END AS text FROM documents
    UNION ALL SELECT 'c' || conv_id || '_' || turn, text FROM conversations), idt AS (SELECT 'scan_' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS identifier FROM documents),
  lk AS (SELECT id, 'recording id' AS leak FROM tx WHERE regexp_matches(text, '\\d{8}_\\d{6}_\\d+') UNION ALL SELECT id, 'host path' FROM tx WHERE regexp_matches(text, '(?:^|[\\s"''])/(?:mnt|home|workspace|data)/')
    UNION ALL SELECT DISTINCT id, 'original identifier' FROM tx WHERE contains(text, 'scan_') AND regexp_extract(text, 'scan_\\d{7}') IN (SELECT identifier FROM idt))"""


def leak_rows(spark, d):
    i = F.col("doc_id")
    doc = V.table(spark, d, "documents").select(F.concat(F.lit("d"), i).alias("id"), F.concat(F.col("text"), F.when(i % 50 == 0, F.concat(F.lit(" video 20240101_120000_"), i)).when(
        i % 50 == 1, F.concat(F.lit(" see /home/u/"), i)).when(i % 50 == 2, F.concat(F.lit(" of xscan_"), F.format_string("%07d", i), F.lit("y"))).otherwise("")).alias("text"))
    conv = V.table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn").alias("id"), "text")
    ids = V.table(spark, d, "documents").select(F.concat(F.lit("scan_"), F.format_string("%07d", i)).alias("identifier"))
    return SH.leaks(doc.unionByName(conv), ids)


@query("x04_leak_scan", f"WITH {TEXTS_SQL} SELECT * FROM lk")
def x04(spark, d):
    return leak_rows(spark, d)


@query("x05_split_exports", f"""WITH {REWRITE_SQL}, {TEXTS_SQL} SELECT CASE WHEN starts_with(video_name, 'validation') THEN 'validation' ELSE 'train' END AS split, count(*) AS rows, count(DISTINCT video_name) AS videos, (SELECT count(*) FROM lk) AS leaks FROM rw GROUP BY 1""", "points")
def x05(spark, d):
    at = scratch_path(spark, "share")
    rows = SH.rewrite(metric_rows(spark, d), alias_map(spark, d)).withColumn("split", F.when(F.col("video_name").startswith("validation"), "validation").otherwise("train"))
    SH.export_splits(rows, at)
    return SH.share_report(spark.read.parquet(at), leak_rows(spark, d))
