"""Table schemas. Every nested label kind is an array of structs; nothing is inferred."""

# Member, kind, task and column names are those of the label files and records they stand for.

CLASSIFICATION = "struct<label:string,confidence:double>"
BOX = "struct<label:string,xmin:double,ymin:double,xmax:double,ymax:double,confidence:double>"
POINT = "struct<x:double,y:double>"
SEGMENT = f"struct<label:string,polygon:array<{POINT}>,confidence:double>"
KEYPOINT = "struct<name:string,x:double,y:double,visible:boolean,confidence:double>"
POSE = f"struct<label:string,keypoints:array<{KEYPOINT}>,confidence:double>"
TEXT = "struct<text:string,xmin:double,ymin:double,xmax:double,ymax:double,confidence:double>"
TRACK = (
    "struct<track_id:string,frame_id:bigint,label:string,"
    "xmin:double,ymin:double,xmax:double,ymax:double,confidence:double>"
)

# Kinds in their fixed order: label streams, first-seen ids and bags all follow it.
KINDS = {
    "classifications": CLASSIFICATION,
    "boxes": BOX,
    "segments": SEGMENT,
    "poses": POSE,
    "texts": TEXT,
    "tracks": TRACK,
}

CORNERS = ("xmin", "ymin", "xmax", "ymax")

TASK_TYPES = (
    "classification",
    "object_detection",
    "segmentation",
    "pose_estimation",
    "ocr",
    "tracking",
    "all",
)

RUN_METRICS_COLUMNS = (
    "image",
    "status",
    "source_model",
    "low_model",
    "high_model",
    "task_type",
    "objects",
    "boxes",
    "segments",
    "poses",
    "texts",
    "tracks",
    "classifications",
    "consistency_score",
    "mean_confidence",
    "uncertainty_score",
    "low_api_attempts",
    "high_api_attempts",
    "elapsed_sec",
    "label_path",
    "label_paths",
    "visualization_path",
)
