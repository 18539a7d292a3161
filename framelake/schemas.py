"""Canonical table schemas."""

from pyspark.sql import types as T

L, I, D, S, B = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


POINT_KEYS = {"video_name": L, "point_index": L}
POINT_REQUIRED = {**POINT_KEYS, "frame_order": I, "x": D, "y": D, "z": D, "pixel_x": D, "pixel_y": D, "intensity": I, "alpha": I, "confidence": D}
POINT_LABELS = {"point_label": I, "valid_mask": B}
POINT_OPTIONAL = {"frame_index": L, "source_type": I, "source_flags": I, "sampling_confidence": D}

POINTS = _schema(**POINT_REQUIRED, **POINT_LABELS, **POINT_OPTIONAL)
BOXES = _schema(video_name=L, frame_order=I, bbox_index=I, object_name=S, xmin=D, ymin=D, xmax=D, ymax=D, valid=B)
POSES = _schema(video_name=L, frame_order=I, pose_prior=T.ArrayType(D), pose_corr=T.ArrayType(D))
MANIFEST = _schema(video_name=S, source_path=S, annotation_root=S, split=S, enabled=S, notes=S)
