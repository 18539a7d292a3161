"""Boxes: transforms, point-in-box labels, candidates and retention.

Boxes live on pixels, so containment becomes equality on (frame, pixel) or
(frame, pixel row); no join here pairs all points with all boxes of a frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framelake.functions.ratios import NULL, finite, ratio
from framelake.operators.layout import lookup, outgrown

FRAME = ["video_name", "frame_order"]


def to_local(boxes: DataFrame, videos: DataFrame, key: str = "video_name") -> DataFrame:
    """Annotation corners to the cropped or resized image, clipped to its last pixel.

    ``videos`` holds preprocess, raw_w/h, local_w/h, resize_scale, crop_left/top;
    the box may bring its own image size (xml_w/h).  Missing sizes fall back
    on each other.
    """
    b = lookup(boxes, videos, [key], F.hash("xmin", "ymin", "xmax", "ymax"), "inner")
    xml_w, xml_h = F.coalesce(finite("xml_w"), F.col("raw_w")), F.coalesce(finite("xml_h"), F.col("raw_h"))
    raw_w = F.when(F.col("raw_w") > 0, F.col("raw_w")).otherwise(xml_w)
    raw_h = F.when(F.col("raw_h") > 0, F.col("raw_h")).otherwise(xml_h)
    fx = F.when((xml_w > 0) & (xml_h > 0), raw_w / xml_w).otherwise(1.0)
    fy = F.when((xml_w > 0) & (xml_h > 0), raw_h / xml_h).otherwise(1.0)
    resized = F.col("preprocess") == "resize"
    scale = F.coalesce(finite("resize_scale"), F.lit(1.0))
    local = {}
    for c, f, raw, size, cut in (("x", fx, raw_w, "local_w", "crop_left"), ("y", fy, raw_h, "local_h", "crop_top")):
        for end in ("min", "max"):
            v = F.col(f"{c}{end}") * f
            v = F.when(resized, v * F.col(size) / raw).otherwise(v * scale - F.coalesce(F.col(cut), F.lit(0.0)))
            local[f"l{c}{end}"] = F.greatest(F.lit(0.0), F.least(F.col(size) - 1.0, v))
    out = b.withColumns(local)
    return out.withColumn("valid_local", (F.col("lxmax") > F.col("lxmin")) & (F.col("lymax") > F.col("lymin")))


def to_crop(boxes: DataFrame, crop: int, mode: str, raw_w: Column | str, raw_h: Column | str, scale: Column | None = None,
            left: Column | None = None, top: Column | None = None) -> DataFrame:
    """Box in crop space before (u*) and after (c*) clipping to the crop's full size."""
    w, h = (F.col(v) if isinstance(v, str) else v for v in (raw_w, raw_h))
    s = F.coalesce(finite(scale), F.lit(1.0)) if scale is not None else F.lit(1.0)
    out = {}
    for c, size, cut in (("x", w, left), ("y", h, top)):
        for end in ("min", "max"):
            v = F.col(f"{c}{end}")
            out[f"u{c}{end}"] = v * crop / size if mode == "resize" else v * s - (cut if cut is not None else F.lit(0.0))
    df = boxes.withColumns(out)
    clip = lambda n: F.greatest(F.lit(0.0), F.least(F.lit(float(crop)), F.col(n)))
    df = df.withColumns({n.replace("u", "c", 1): clip(n) for n in out})
    return df.withColumns({f"c{c}max": F.greatest(f"c{c}max", f"c{c}min") for c in "xy"})


def crop_geometry(h: Column, w: Column, crop_h: int, crop_w: int, off_y: Column, off_x: Column, short_side: int | None = None) -> dict[str, Column]:
    """Where an offset crop falls in an image, optionally after scaling the shorter side.

    Rounds half to even; a crop larger than the image becomes a resize.
    """
    scale = F.lit(1.0)
    if short_side is not None:
        if short_side < min(crop_h, crop_w):
            raise ValueError("short side must hold the crop")
        scale = F.lit(float(short_side)) / F.least(h, w)
        h, w = F.rint(h * scale), F.rint(w * scale)
    small = (h < crop_h) | (w < crop_w)
    top, left = F.rint(h / 2 + off_y - crop_h / 2), F.rint(w / 2 + off_x - crop_w / 2)
    in_top, in_left = F.least(F.greatest(top, F.lit(0.0)), h - crop_h), F.least(F.greatest(left, F.lit(0.0)), w - crop_w)
    put = lambda small_value, value: F.when(small, small_value).otherwise(value)
    none = F.lit(None).cast("double")
    return {
        "effective": F.lit("resize_shorter_then_offset_crop") if short_side is not None else put("offset_crop_fallback_resize", F.lit("offset_crop")),
        "resized_h": h.cast("int") if short_side is not None else put(crop_h, h).cast("int"),
        "resized_w": w.cast("int") if short_side is not None else put(crop_w, w).cast("int"),
        "crop_top": put(0, in_top).cast("int"), "crop_left": put(0, in_left).cast("int"),
        "resize_scale": scale if short_side is not None else put(none, scale),
        "crop_clipped": put(True, (in_top != top) | (in_left != left)),
    }


def visibility(crops: DataFrame, crop: int, keys: Sequence[str]) -> DataFrame:
    """How much of the boxes a crop shows; boxes without area are skipped."""
    area = lambda p: F.greatest(F.col(f"{p}xmax") - F.col(f"{p}xmin"), F.lit(0.0)) * F.greatest(F.col(f"{p}ymax") - F.col(f"{p}ymin"), F.lit(0.0))
    b = crops.withColumn("_full", area("u")).filter(F.col("_full") > 1e-6).withColumn("_seen", area("c"))
    w, h = F.col("cxmax") - F.col("cxmin"), F.col("cymax") - F.col("cymin")
    b = b.select(*keys, (F.col("_seen") / F.col("_full")).alias("vr"), (F.col("_seen") / (crop * crop)).alias("ar"), (w / crop).alias("wr"),
                 (h / crop).alias("hr"), (F.sqrt(w * w + h * h) / F.sqrt(F.lit(2.0 * crop * crop))).alias("dr"))
    share = lambda c: F.avg(c.cast("double"))
    return b.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_boxes"), F.avg("vr").alias("visible_mean"), F.min("vr").alias("visible_min"), F.avg("ar").alias("area_mean"),
        F.avg("wr").alias("width_mean"), F.avg("hr").alias("height_mean"), F.avg("dr").alias("diag_mean"),
        F.avg(F.col("vr") * F.sqrt("ar")).alias("score_area"), F.avg(F.col("vr") * F.col("dr")).alias("score_diag"),
        share(F.col("vr") >= 0.95).alias("fully_inside"), share(F.col("vr") > 0).alias("partially"), share(F.col("vr") <= 0).alias("missing"))


def margin_labels(points: DataFrame, boxes: DataFrame, margin: float = 0.0, no_box_label: int = 0) -> DataFrame:
    """1 inside the frame's box, -1 in a band along its edges, 0 elsewhere in a box frame.

    One valid box per frame; frames without one take ``no_box_label``.
    """
    one = boxes.filter("valid").groupBy(*FRAME).agg(F.min_by(F.struct("xmin", "ymin", "xmax", "ymax"), "bbox_index").alias("_b"))
    p = lookup(points, one, FRAME, F.col("point_index"))
    x, y, b = F.col("pixel_x"), F.col("pixel_y"), F.col("_b")
    inside = x.between(b["xmin"], b["xmax"]) & y.between(b["ymin"], b["ymax"])
    near = ((F.abs(x - b["xmin"]) <= margin) | (F.abs(x - b["xmax"]) <= margin) | (F.abs(y - b["ymin"]) <= margin) | (F.abs(y - b["ymax"]) <= margin))
    label = F.when(b.isNull(), no_box_label).when(inside & near & F.lit(margin > 0), -1).when(inside, 1).otherwise(0)
    return p.withColumn("label", label).withColumn("label_valid", F.col("label") != -1).drop("_b")


def _cells(boxes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    whole = lambda lo, hi: F.sequence(F.floor(lo).cast("int"), F.ceil(hi).cast("int"))
    rows = boxes.select(*FRAME, *keep, F.explode(whole(F.col("ymin"), F.col("ymax"))).alias("py"), "xmin", "xmax")
    return rows.select(*FRAME, *keep, "py", F.explode(whole(F.col("xmin"), F.col("xmax"))).alias("px"))


def box_cells(boxes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Distinct pixels of a frame inside any of its boxes, bounds widened to whole pixels."""
    return _cells(boxes, keep).distinct()


def pixel(points: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """Rounded (half to even) pixel of each point, clipped to the image when its size is given."""
    def r(c, size):
        v = F.rint(c)
        if size is not None:
            v = F.greatest(F.lit(0.0), F.least(F.lit(float(size - 1)), v))
        return v.cast("int")
    return points.withColumns({"px": r("pixel_x", width), "py": r("pixel_y", height)})


def in_cells(points: DataFrame, cells: DataFrame, flag: str) -> DataFrame:
    """Flag points whose pixel is among the cells (one row per cell)."""
    marked = cells.select(*FRAME, "px", "py", F.lit(True).alias(flag))
    return points.join(outgrown(marked), [*FRAME, "px", "py"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def count_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points inside any box by the boxes' exact bounds.

    The pixel row is part of the join key, so a crowded frame is spread over
    its rows; a point is kept once however many boxes hold it.
    """
    rows = boxes.select(*FRAME, F.explode(F.sequence(F.floor("ymin").cast("int"), F.floor("ymax").cast("int"))).alias("_row"),
                        "xmin", "ymin", "xmax", "ymax").distinct()
    p = points.withColumn("_row", F.floor("pixel_y").cast("int"))
    on = [p[k] == rows[k] for k in [*FRAME, "_row"]]
    on += [p["pixel_x"].between(rows["xmin"], rows["xmax"]), p["pixel_y"].between(rows["ymin"], rows["ymax"])]
    return p.join(outgrown(rows), on, "left_semi").drop("_row")


def policy_labels(points: DataFrame, boxes: DataFrame, contour: DataFrame, no_box_label: int = 0) -> DataFrame:
    """Positive in the contour, ignored elsewhere in a box, background in the rest of box frames."""
    cell = [*FRAME, "px", "py"]
    marks = _cells(boxes).select(*cell, F.lit(1).alias("_in")).unionByName(contour.select(*cell, F.lit(2).alias("_in"))).groupBy(*cell).agg(F.bit_or("_in").alias("_in"))
    held = lambda bit: F.coalesce(F.col("_in").bitwiseAND(F.lit(bit)) != 0, F.lit(False))
    p = pixel(points).join(outgrown(marks), cell, "left").withColumns({"in_box": held(1), "in_contour": held(2)}).drop("_in")
    framed = boxes.select(*FRAME).distinct().withColumn("box_frame", F.lit(True))
    p = lookup(p, framed, FRAME, F.col("point_index"))
    label = F.when(F.col("in_contour"), 1).when(F.col("in_box"), -1).when(F.col("box_frame"), 0).otherwise(no_box_label)
    return p.withColumn("label", label).withColumn("label_valid", F.col("label") != -1).withColumn("box_frame", F.coalesce("box_frame", F.lit(False)))


# Where annotation files may lie and how they may be called, in order of preference.
ANNOTATION_DIRS = ["annotations_renamed", "annotation_renamed", "annotations_rename", "annotation_rename", "annotations"]
NUMBER_WIDTHS = [0, 4, 5, 6]
NAME_PREFIXES = ["", "frame_", "VIDEO_", "VIDEO-", "VIDEO_frame_"]


def _readings(files: DataFrame) -> DataFrame:
    """Every way to read an annotation path as (video or NULL, number, rank parts).

    A padded number must have one of the known widths; a plain one is the
    first choice.
    """
    # Parts that are read several times become columns, so each is worked out once.
    cut = files.select("path").distinct().withColumn("_name", F.substring_index("path", "/", -1))
    cut = cut.withColumn("_token", F.regexp_extract("_name", r"(\d+)\.xml$", 1)).filter(F.col("_token") != "")
    cut = cut.withColumn("_before", F.substring("_name", F.lit(1), F.length("_name") - F.length("_token") - 4))
    cut = cut.withColumn("_folder", F.rtrim(F.substring("path", F.lit(1), F.length("path") - F.length("_name")), F.lit("/")))
    token, before, folder = F.col("_token"), F.col("_before"), F.col("_folder")
    plain = token == token.cast("decimal(38,0)").cast("string")
    width = F.when(plain, 0)
    for i, n in enumerate(NUMBER_WIDTHS):
        if n:
            width = width.when(F.length(token) == n, i)
    null = F.lit(None).cast("string")
    shape = lambda i, named: F.struct(F.lit(i).alias("shape"), named.alias("named"))
    shapes = [F.when(before == "", shape(0, null)).when(before == "frame_", shape(1, null))]
    for i, p in enumerate(NAME_PREFIXES):
        if p.startswith("VIDEO"):
            end = p[5:]
            named = F.substring(before, F.lit(1), F.length(before) - len(end))
            shapes.append(F.when(before.endswith(end) & (F.length(before) > len(end)), shape(i, named)))
    place = lambda i, held: F.struct(i.cast("int").alias("dir"), held.alias("held"))
    first, last = F.substring_index(folder, "/", 1), F.substring_index(folder, "/", -1)
    known = F.array_position(F.array(*[F.lit(n) for n in ANNOTATION_DIRS]), last)
    single, double = (folder != "") & (first == folder), (first != folder) & (F.concat_ws("/", first, last) == folder)
    dirs = [F.when(folder == "", place(F.lit(0), null)).when(single, place(F.lit(1), folder)).when(double & (known > 0), place(known + 1 + len(ANNOTATION_DIRS), first)),
            F.when(single & (known > 0), place(known + 1, null))]
    some = lambda a: F.filter(F.array(*a), lambda v: v.isNotNull())
    out = cut.select("path", token.cast("bigint").alias("number"), width.alias("width"), some(shapes).alias("_s"), some(dirs).alias("_d"))
    out = out.filter(F.col("width").isNotNull()).withColumn("_s", F.explode("_s")).withColumn("_d", F.explode("_d")).select("path", "number", "width", "_s.*", "_d.*")
    return out.filter(F.col("named").isNull() | F.col("held").isNull() | (F.col("named") == F.col("held"))).select(
        "path", "number", "width", "shape", "dir", F.coalesce("named", "held").alias("video"))


def match_annotations(frames: DataFrame, files: DataFrame, offsets: Sequence[int] = (0,), id_source: str = "both") -> DataFrame:
    """First existing annotation file of each frame, by folder, frame id, number width and name shape.

    ``files`` holds paths relative to the annotation root.  Each path is read
    backwards into the video and number it can stand for, so a frame meets
    only files of its own number and the many possible names of a frame are
    never written out.  Numbers are not negative.
    """
    ids = {"frame_index": ["frame_index"], "frame_order": ["frame_order"], "both": ["frame_index", "frame_order"]}[id_source]
    tries = [F.struct((F.col(i) + off).cast("bigint").alias("number"), F.lit(k * len(offsets) + j).alias("turn")) for k, i in enumerate(ids) for j, off in enumerate(offsets)]
    f = frames.select("video_name", "frame_order", F.explode(F.array(*tries)).alias("_t")).select("video_name", "frame_order", "_t.*")
    r = _readings(files)
    named = f.withColumn("video", F.col("video_name").cast("string")).join(r.filter(F.col("video").isNotNull()), ["video", "number"])
    loose = f.join(r.filter(F.col("video").isNull()).drop("video"), "number")
    per_turn = len(NUMBER_WIDTHS) * len(NAME_PREFIXES)
    rank = F.col("dir") * (len(tries) * per_turn) + F.col("turn") * per_turn + F.col("width") * len(NAME_PREFIXES) + F.col("shape")
    both = named.drop("video").unionByName(loose)
    return both.withColumn("rank", rank).groupBy("video_name", "frame_order").agg(F.min_by("path", "rank").alias("path"), F.min("rank").alias("rank"))


def retention(teacher: DataFrame, selected: DataFrame, labels: DataFrame, boxes: DataFrame, configs: Sequence[str]) -> DataFrame:
    """Per configuration and box: teacher pixels kept, and what else was selected inside the box.

    ``teacher`` holds one row per positive pixel of a box, ``selected`` one per
    (config, selected pixel), ``labels`` the label of the pixels that are not
    background.  Boxes without any selection stay, with zeros.
    """
    cell, box = [*FRAME, "px", "py"], [*FRAME, "bbox_index"]
    kept = outgrown(teacher).join(selected, cell).groupBy("config", *box).agg(F.count(F.lit(1)).alias("selected_positive"))
    lab = selected.join(outgrown(labels.select(*cell, "label")), cell, "left").withColumn("label", F.coalesce("label", F.lit(0)))
    inside = outgrown(box_cells(boxes, ["bbox_index"])).join(lab, cell).groupBy("config", *box).agg(
        F.count(F.lit(1)).alias("selected_total"), F.count_if(F.col("label") == 0).alias("selected_background"), F.count_if(F.col("label") == -1).alias("selected_ignore"))
    whole = teacher.groupBy(*box).agg(F.count(F.lit(1)).alias("teacher_positive"))
    out = boxes.select(*box, "valid").join(outgrown(whole), box, "left").withColumn("config", F.explode(F.array(*[F.lit(c) for c in configs])))
    out = out.join(outgrown(inside), ["config", *box], "left").join(outgrown(kept), ["config", *box], "left")
    out = out.fillna(0, ["teacher_positive", "selected_positive", "selected_total", "selected_background", "selected_ignore"])
    return out.withColumn("recall", ratio("selected_positive", "teacher_positive", NULL)).withColumn(
        "zero_positive", F.col("valid") & (F.col("selected_positive") == 0))


def extent_recall(teacher: DataFrame, selected: DataFrame, min_elongation: float, configs: Sequence[str]) -> DataFrame:
    """Selected over teacher extent along the principal axis of a box's positive pixels.

    NULL for fewer than three pixels or a round shape, 0 for fewer than two
    selected pixels.  The 2x2 eigenpair is closed form.  Moments come from sums
    of whole pixel numbers, so neither the order of rows nor their partitions
    decide how a tie of the last digit is rounded.
    """
    box = [*FRAME, "bbox_index"]
    x, y = F.col("px").cast("bigint"), F.col("py").cast("bigint")
    teacher = teacher.repartition(*box)  # one shuffle for moments, projections and extents

    def sums(k, u, v):
        # Upper and lower bits of products are summed apart: exact, and no sum outgrows a bigint.
        uv = u * v
        held = lambda w: F.sum(F.when(uv.isNotNull(), w))
        return [c.alias(f"{k}{name}") for name, c in (("n", F.count(uv)), ("u", held(u)), ("v", held(v)), ("hi", F.sum(F.shiftright(uv, 31))), ("lo", F.sum(uv.bitwiseAND(F.lit(2**31 - 1)))))]

    m = teacher.groupBy(*box).agg(F.count(F.lit(1)).alias("_n"), *sums("_a", x, x), *sums("_c", y, y), *sums("_b", x, y))

    def times_n(k):
        n, u, v, hi, lo = [F.col(f"{k}{name}").cast("decimal(19,0)") for name in ("n", "u", "v", "hi", "lo")]
        return (n * (hi * F.lit(2**31).cast("decimal(10,0)") + lo) - u * v).cast("double").alias(k)

    m = m.select(*box, "_n", "_an", "_cn", "_bn", times_n("_a"), times_n("_c"), times_n("_b"))

    def axes(a, c, b):
        half, mid = (a - c) / 2, (a + c) / 2
        root = F.sqrt(half * half + b * b)
        return mid + root, mid - root

    a, c, b = [F.col(k) / F.col(f"{k}n") / F.nullif(F.col(f"{k}n") - 1, F.lit(0)) for k in ("_a", "_c", "_b")]
    major, minor = axes(a, c, b)
    elongation, angle = major / F.greatest(minor, F.lit(1e-12)), 0.5 * F.atan2(2 * b, a - c)
    # Before they are divided the moments are whole numbers: a shape that just reaches the wanted elongation does so here.
    long, short = axes(F.col("_a"), F.col("_c"), F.col("_b"))
    enough = F.when((F.col("_an") == F.col("_bn")) & (F.col("_cn") == F.col("_bn")), long >= min_elongation * short).otherwise(elongation >= min_elongation)
    m = m.select(*box, F.when(F.col("_n") >= 3, elongation).alias("elongation"), ((F.col("_n") >= 3) & enough).alias("_usable"),
                 F.cos(angle).alias("_vx"), F.sin(angle).alias("_vy"))
    proj = outgrown(teacher).join(m, box).withColumn("_t", F.col("px") * F.col("_vx") + F.col("py") * F.col("_vy"))
    whole = proj.groupBy(*box).agg(F.first("_usable").alias("_usable"), F.first("elongation").alias("elongation"), (F.max("_t") - F.min("_t")).alias("_whole"))
    part = outgrown(proj).join(selected, [*FRAME, "px", "py"]).groupBy("config", *box).agg(F.count(F.lit(1)).alias("_k"), (F.max("_t") - F.min("_t")).alias("_part"))
    out = whole.withColumn("config", F.explode(F.array(*[F.lit(c) for c in configs]))).join(outgrown(part), ["config", *box], "left")
    value = F.when(F.coalesce("_k", F.lit(0)) < 2, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_part") / F.col("_whole"))))
    return out.select("config", *box, "elongation", F.when(F.col("_usable") & (F.col("_whole") > 0), value).alias("extent_recall"))


def component_scores(parts: DataFrame, boxes: DataFrame, center_weight: float = 0.7, area_weight: float = 0.3, max_distance: float = 0.5,
                     enough_area: float = 0.2, min_area_ratio: float = 0.02, min_area: float = 1) -> DataFrame:
    """Score the components of a box by closeness to its centre and by size.

    ``parts`` holds one row per cell: frame, bbox_index, source, component, px, py.
    Area is the number of cells.
    """
    box = [*FRAME, "bbox_index"]
    c = parts.groupBy(*box, "source", "component").agg(F.count(F.lit(1)).alias("area"), F.avg("px").alias("mx"), F.avg("py").alias("my"))
    c = outgrown(c).join(boxes.select(*box, "xmin", "ymin", "xmax", "ymax"), box)
    w, h = F.col("xmax") - F.col("xmin") + 1, F.col("ymax") - F.col("ymin") + 1
    dx, dy = F.col("mx") - (F.col("xmin") + F.col("xmax")) / 2, F.col("my") - (F.col("ymin") + F.col("ymax")) / 2
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    c = c.withColumns({"distance": F.sqrt(dx * dx + dy * dy) / F.sqrt(w * w + h * h), "area_ratio": F.col("area") / (w * h)})
    c = c.withColumns({"center_score": unit(1 - F.col("distance") / max_distance), "area_score": unit(F.col("area_ratio") / enough_area)})
    score = (center_weight * F.col("center_score") + area_weight * F.col("area_score")) / (center_weight + area_weight)
    ok = (F.col("area") >= min_area) & (F.col("area_ratio") >= min_area_ratio) & (F.col("distance") <= max_distance)
    return c.withColumn("score", score).withColumn("eligible", ok).drop("xmin", "ymin", "xmax", "ymax")


RANK = ["score", "nearness", "area_score", "area"]


def pick_ranked(scored: DataFrame, cell_hash: DataFrame) -> DataFrame:
    """Best eligible candidate per box; two equal ones are shared if they cover the same cells, else ambiguous.

    ``cell_hash`` gives an order-free digest of each candidate's cells.
    """
    box = [*FRAME, "bbox_index"]
    ok = scored.filter("eligible").join(outgrown(cell_hash), [*box, "source", "component"]).withColumn("nearness", -F.col("distance"))
    w = W.partitionBy(*box).orderBy(*[F.desc(c) for c in RANK], "source", "component")
    r = ok.withColumn("_r", F.row_number().over(w)).withColumns({f"_n{c}": F.lead(c).over(w) for c in [*RANK, "cells"]})
    top = r.filter(F.col("_r") == 1)
    tie = F.col("_nscore").isNotNull()
    for c in RANK:
        tie = tie & (F.abs(F.col(c) - F.col(f"_n{c}")) <= 1e-12)
    same = F.col("cells") == F.col("_ncells")
    none = F.lit("none")
    picked = top.select(*box, (~tie | same).alias("valid"),
                        F.when(tie & same, "shared").when(tie, none).otherwise(F.col("source")).alias("selected_source"),
                        F.when(tie & same, "identical_candidates").when(tie, "ambiguous_equal_candidates").otherwise("selected").alias("reason"),
                        F.col("score").alias("selected_score"), "component")
    missing = scored.select(*box).distinct().join(outgrown(picked), box, "left")
    return missing.select(*box, F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("selected_source", none).alias("selected_source"),
                          F.coalesce("reason", F.lit("no_eligible_candidate")).alias("reason"), "selected_score", "component")


def cells_digest(parts: DataFrame) -> DataFrame:
    """Digest of a candidate's cell set, combined before the shuffle."""
    box = [*FRAME, "bbox_index", "source", "component"]
    h = F.xxhash64("px", "py").cast("decimal(38,0)")
    return parts.groupBy(*box).agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(h), F.bit_xor(F.xxhash64("px", "py"))).alias("cells"))


def largest_component(boxes: DataFrame, parts: DataFrame, min_area: int) -> DataFrame:
    """Largest component of each box, or the reason why there is none."""
    box = [*FRAME, "bbox_index"]
    sizes = parts.groupBy(*box, "component").agg(F.count(F.lit(1)).alias("area"))
    best = sizes.groupBy(*box).agg(F.max("area").alias("area"), F.max_by("component", F.struct("area", -F.col("component"))).alias("component"))
    out = boxes.select(*box, "valid").join(outgrown(best), box, "left")
    reason = (F.when(~F.col("valid"), "invalid_bbox").when(F.col("area").isNull(), "empty_binary_mask")
              .when(F.col("area") < min_area, "contour_area_below_threshold").otherwise("ok"))
    return out.withColumn("reason", reason).withColumn("component", F.when(F.col("reason") == "ok", F.col("component")))


def first_good_attempt(attempts: DataFrame, keys: Sequence[str], enough: int) -> DataFrame:
    """First attempt with enough positives, else the best so far, earliest on ties.

    ``attempts`` holds attempt (0 is the plain one), valid, positives.
    """
    keys = list(keys)
    got = F.when(F.col("valid"), F.col("positives")).otherwise(0)
    a = attempts.withColumn("_got", got)
    good = F.col("valid") & (F.col("_got") >= enough)
    row = F.struct("attempt", "valid", F.col("_got").alias("positives"))
    out = a.groupBy(*keys).agg(F.min_by(row, F.when(good, F.col("attempt"))).alias("_first"),
                               F.max_by(row, F.struct("_got", -F.col("attempt"))).alias("_best"), F.max(good).alias("_any"), F.max("attempt").alias("_last"))
    pick = F.when(F.col("_any"), F.col("_first")).otherwise(F.col("_best"))
    return out.select(*keys, pick["attempt"].alias("attempt"), pick["positives"].alias("positives"), F.col("_any").alias("valid"), (pick["attempt"] > 0).alias("fallback_used"),
                      F.when(F.col("_any"), "ok").when(pick["valid"], "fallback_positive_points_below_threshold").otherwise("no_valid_attempt").alias("status"))


def hard_frames(spine: DataFrame, points: DataFrame, boxes: DataFrame, low: int) -> DataFrame:
    """Frames whose boxes hold no or few points."""
    n = points.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("num_points"), F.count_if(F.col("point_label") == 1).alias("num_positive"))
    k = count_in_boxes(points, boxes.filter("valid")).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("points_in_box"))
    b = boxes.filter("valid").groupBy(*FRAME).agg(F.max((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).alias("max_box_area"))
    out = outgrown(spine).join(n, FRAME, "left").join(k, FRAME, "left").join(outgrown(b), FRAME, "left").fillna(0, ["num_points", "num_positive", "points_in_box"])
    has, inside = F.col("max_box_area").isNotNull(), F.col("points_in_box")
    kind = (F.when(~has, "no_box").when((inside == 0) & (F.col("num_points") > 0), "zero_with_points").when(inside == 0, "zero_empty")
            .when(inside <= low, "low").otherwise("enough"))
    return out.withColumn("kind", kind).withColumn("eligible", has & (F.col("num_points") > 0))


def annotation_frames(spine: DataFrame, points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Frames with and without positive points, and those without that still have a valid box."""
    pos = points.filter(F.col("point_label") == 1).groupBy(*FRAME).agg(F.lit(True).alias("_pos"))
    ok = boxes.filter("valid").select(*FRAME).distinct().withColumn("_ok", F.lit(True))
    f = outgrown(spine).join(pos, FRAME, "left").join(outgrown(ok), FRAME, "left")
    none = F.col("_pos").isNull()
    return f.groupBy("video_name").agg(F.count(F.lit(1)).alias("frames"), F.count_if(~none).alias("positive_frames"), F.count_if(none).alias("zero_positive_frames"),
                                       F.count_if(none & F.col("_ok").isNotNull()).alias("zero_positive_with_valid_box"))


def recovery(spine: DataFrame, old: DataFrame, new: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points in the boxes of every box frame under two samplings; losing points stops the query."""
    ok = boxes.filter("valid")
    per = lambda df, n: count_in_boxes(df, ok).groupBy(*FRAME).agg(F.count(F.lit(1)).alias(n))
    total = new.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("frame_points"))
    f = ok.select(*FRAME).distinct().join(outgrown(per(old, "old")), FRAME, "left").join(outgrown(per(new, "new")), FRAME, "left").join(total, FRAME, "left")
    f = f.fillna(0, ["old", "new", "frame_points"])
    f = f.withColumn("new", F.when(F.col("new") >= F.col("old"), F.col("new")).otherwise(F.raise_error(F.lit("new sampling lost points in a box")).cast("bigint")))
    target = (F.col("old") == 0) & (F.col("frame_points") > 0)
    return f.groupBy("video_name").agg(
        F.count(F.lit(1)).alias("box_frames"), F.sum("old").alias("old_points"), F.sum("new").alias("new_points"), F.count_if(target).alias("targets"),
        F.count_if(target & (F.col("new") > 0)).alias("recovered"), F.sum(F.col("new") - F.col("old")).alias("added"), F.min("new").alias("min_new"), F.max("new").alias("max_new")
    ).withColumn("multiplier", ratio("new_points", "old_points", NULL))


def annotation_summary(boxes: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per video: boxes, annotated and valid frames, fallbacks, labelled points, picks by source."""
    b = boxes.groupBy("video_name").agg(
        F.count(F.lit(1)).alias("boxes"), F.count_distinct("frame_order").alias("annotated_frames"), F.count_if("valid").alias("valid_boxes"),
        F.count_distinct(F.when(F.col("valid"), F.col("frame_order"))).alias("valid_frames"), F.count_if("fallback_used").alias("fallback_uses"),
        *[F.count_if(F.col("selected_source") == s).alias(f"selected_{s}") for s in ("global", "local_percentile", "shared", "none")])
    n = labelled.groupBy("video_name").agg(F.count_if(F.col("point_label") == 1).alias("labelled_points"))
    return b.join(n, "video_name", "left").fillna(0, ["labelled_points"])


def label_policy_audit(labelled: DataFrame, allowed: Sequence[int] = (-1, 0, 1)) -> DataFrame:
    """Violations of the labelling policy; every count should be zero."""
    lab = F.col("label")
    return labelled.agg(
        F.count(F.lit(1)).alias("points"), F.count_if(F.col("label_valid") != (lab != -1)).alias("valid_mismatch"), F.count_if(~lab.isin(*allowed)).alias("unexpected_label"),
        F.count_if(~F.col("box_frame") & (lab != 0)).alias("no_box_not_background"), F.count_if(F.col("in_box") & (lab == 0)).alias("background_in_box"),
        F.count_if(lab == 1).alias("positive"), F.count_if(lab == -1).alias("ignored"))


def selection_audit(boxes: DataFrame) -> DataFrame:
    """Valid boxes name a source, invalid ones none, and a local pick is no worse than the global one."""
    src = F.col("selected_source")
    return boxes.agg(
        F.count_if(F.col("valid") & ~src.isin("global", "local_percentile", "shared")).alias("valid_without_source"), F.count_if(~F.col("valid") & (src != "none")).alias("invalid_with_source"),
        F.count_if((src == "local_percentile") & (F.col("selected_score") < F.col("global_score") - 1e-7)).alias("worse_local_pick"), F.count(F.lit(1)).alias("boxes"))


def frame_consistency(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Points whose frame is unknown or misnumbered, and frames whose stated count is wrong."""
    n = points.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.lit(True)).alias("_m"))
    j = n.join(frames.select(*FRAME, "num_points"), FRAME, "full")
    return j.agg(F.sum(F.when(F.col("num_points").isNull(), F.col("_n")).otherwise(0)).alias("points_outside_frames"),
                 F.count_if(F.col("num_points").isNotNull() & (F.coalesce("_n", F.lit(0)) != F.col("num_points"))).alias("wrong_counts"), F.coalesce(F.sum("_n"), F.lit(0)).alias("points"))
