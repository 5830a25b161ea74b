"""Readers and writers of track files: MOT text in its variants, sequence lists, annotations, detection caches, event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxtrail.functions import geometry as g
from boxtrail.operators.validate import mot_issues

FIELDS = ["frame", "track_id", "x", "y", "w", "h", "conf", "class_id", "visibility", "reserved"]
ANNOTATION = (
    "sequence struct<name:string,fps:double,width:int,height:int,frame_count:int>, "
    "frames array<struct<frame_index:long,image:string,width:int,height:int,objects:array<struct<track_id:string,class:string,bbox:array<double>,confidence:double,visibility:double>>>>"
)
CACHE = ("sequence_name string, frame_index long, detections array<struct<class_id:int,class_name:string,confidence:double,bbox_xyxy:array<double>>>, stage_seconds map<string,double>")
EVENT = ("event_id string, sequence string, track_id long, type string, severity string, start long, `end` long, trigger long")


def _file_stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files: sequence (from the file's name), line_number within the file, fields. Files are numbered by their own order: a file is read as one
    text, as MOT files hold one sequence."""
    files = spark.read.text(path, wholetext=True).select(_file_stem().alias("sequence"), "value")
    rows = files.select("sequence", F.posexplode(F.split("value", r"\r?\n")).alias("line_number", "line"))
    return rows.where(F.trim("line") != "").select("sequence", (F.col("line_number") + 1).alias("line_number"), F.split("line", r"\s*,\s*").alias("fields"))


def _number(i: int) -> Column:
    return F.get("fields", F.lit(i)).try_cast("double")


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    """Strict: at least 6 fields, whole frame and track numbers, finite values, no repeated (frame, track), else the read fails. A negative or missing
    confidence is null. Corners x2, y2 are added; line_number keeps the order of rows."""
    rows = lines(spark, path).withColumns({f: _number(i) for i, f in enumerate(FIELDS)})
    whole = lambda c: F.col(c).isNotNull() & (F.floor(c) == F.col(c))
    fine = (F.size("fields") >= 6) & whole("frame") & whole("track_id") & g.finite(*[F.col(c) for c in ("x", "y", "w", "h")])
    copies = F.count("*").over(W.partitionBy("sequence", "frame", "track_id"))
    must = lambda test, text: F.when(~test, F.raise_error(F.concat(F.lit(f"{text} in "), F.col("sequence"), F.lit(" line "), F.col("line_number").cast("string"))))
    error = F.coalesce(must(fine, "bad row").cast("string"), must(copies == 1, "repeated frame and track").cast("string"), F.lit(""))
    rows = rows.withColumn("sequence", F.concat("sequence", error))
    conf = F.when(F.col("conf") >= 0, F.col("conf"))
    return rows.select("sequence", F.col("frame").cast("long").alias("frame"), F.col("track_id").cast("long").alias("track_id"), "x", "y", "w", "h", (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), conf.alias("conf"), F.col("class_id").cast("int").alias("class_id"), "visibility", "line_number")


def read_mot_lenient(spark: SparkSession, path: str, ground_truth: bool = False) -> DataFrame:
    """For evaluation: short or unreadable rows and ids under 1 are skipped, numbers truncated, a missing score is 1; ground truth with no positive score is skipped."""
    rows = lines(spark, path).where(F.size("fields") >= 6).withColumns({f: _number(i) for i, f in enumerate(FIELDS[:7])})
    rows = rows.where(F.forall(F.slice("fields", 1, 6), lambda v: v.try_cast("double").isNotNull()))
    cut = lambda c: F.signum(c) * F.floor(F.abs(c))
    rows = rows.withColumns({"frame": cut(F.col("frame")).cast("long"), "track_id": cut(F.col("track_id")).cast("long"), "conf": F.coalesce("conf", F.lit(1.0))}).where("track_id >= 1")
    return (rows.where("conf > 0") if ground_truth else rows).drop("fields")


def read_mot_context(spark: SparkSession, path: str, first_id: int = 1, positive_area: bool = True) -> DataFrame:
    """Ids truncated, frames from 1 and ids from first_id on, and a positive size unless said otherwise; repeated rows are kept. Ordered by frame and track."""
    rows = read_mot_lenient(spark, path) if first_id >= 1 else lines(spark, path).where(F.size("fields") >= 6).withColumns({f: _number(i) for i, f in enumerate(FIELDS[:7])}).drop("fields")
    rows = rows.withColumns({"frame": F.col("frame").cast("long"), "track_id": F.col("track_id").cast("long")}).where((F.col("frame") >= 1) & (F.col("track_id") >= first_id))
    return (rows.where("w > 0 and h > 0") if positive_area else rows).orderBy("sequence", "frame", "track_id")


def read_mot_classes(spark: SparkSession, path: str, default: int = 1) -> DataFrame:
    """Lenient rows with class_id from the eighth field, `default` where it is missing."""
    cls = lines(spark, path).select("sequence", "line_number", _number(7).cast("int").alias("class_id"))
    return read_mot_lenient(spark, path).join(cls, ["sequence", "line_number"]).withColumn("class_id", F.coalesce("class_id", F.lit(default)))


def mot_text(rows: DataFrame, gt: bool = False) -> DataFrame:
    """(sequence, frame, track_id, value): rows as text, six digits, -1 for a missing confidence. A repeated (frame, track) raises, or keeps the first by line_number for ground truth."""
    order = W.partitionBy("sequence", "frame", "track_id").orderBy("line_number" if "line_number" in rows.columns else "x")
    r = rows.withColumn("_i", F.row_number().over(order))
    r = r.where("_i = 1") if gt else r.withColumn("frame", F.when(F.col("_i") == 1, F.col("frame")).otherwise(F.raise_error(F.lit("repeated frame and track")).cast("long")))
    conf = F.coalesce(F.nullif("conf", F.lit(0.0)), F.lit(1.0)) if gt else F.coalesce("conf", F.lit(-1.0))
    value = F.format_string("%d,%d,%.6f,%.6f,%.6f,%.6f,%.6f,1,1.000000", "frame", "track_id", "x", "y", "w", "h", conf)
    return r.select("sequence", "frame", "track_id", value.alias("value"))


def write_mot(rows: DataFrame, path: str, gt: bool = False, mode: str = "errorifexists") -> None:
    """One folder of text per sequence, in order of frame and track within each file."""
    text = mot_text(rows, gt).repartition("sequence").sortWithinPartitions("sequence", "frame", "track_id")
    text.select("sequence", "value").write.mode(mode).partitionBy("sequence").text(path)


def read_seqinfo(spark: SparkSession, path: str) -> DataFrame:
    """The [Sequence] section of INI files: a row for each file with name, imDir, frameRate, seqLength, imWidth, imHeight, imExt; keys are case-sensitive."""
    keys = {"name": "string", "imDir": "string", "frameRate": "double", "seqLength": "int", "imWidth": "int", "imHeight": "int", "imExt": "string"}
    section = F.regexp_extract("value", r"(?s)\[Sequence\](.*?)(?:\n\[|$)", 1)
    text = spark.read.text(path, wholetext=True).select(section.alias("s"), F.col("_metadata.file_path").alias("file"))
    value = lambda k: F.nullif(F.trim(F.regexp_extract("s", rf"(?m)^\s*{k}\s*=\s*(.*?)\s*$", 1)), F.lit(""))
    must = lambda k: F.coalesce(value(k), F.raise_error(F.concat(F.lit(f"{k} is missing in "), F.col("file"))).cast("string"))
    return text.select("file", *[must(k).cast(t).alias(k) for k, t in keys.items()])


def read_seqmap(spark: SparkSession, path: str) -> DataFrame:
    """Sequence names without the header and blank lines; of paths the last part."""
    name = F.element_at(F.split(F.regexp_replace(F.trim("value"), r"\\", "/"), "/"), -1)
    return spark.read.text(path).where((F.trim("value") != "") & (F.trim("value") != "name")).select(name.alias("sequence")).distinct()


def discover(spark: SparkSession, root: str, seqmap: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Sequences below a folder with seqinfo.ini; of a seqmap those that exist, and an error for one that doesn't."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "seqinfo.ini").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", r"([^/]+)/seqinfo\.ini$", 1).alias("sequence")).distinct()
    if seqmap is not None:
        missing = [r.sequence for r in seqmap.join(found, "sequence", "left_anti").limit(20).collect()]
        if missing:
            raise FileNotFoundError(f"sequences of the seqmap that do not exist: {missing}")
        found = found.join(seqmap, "sequence", "left_semi")
    return found.orderBy("sequence").limit(most) if most else found.orderBy("sequence")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Nested annotation JSON as one row per object; frames without objects give a row with null track_id. x2, y2 are bbox[2:]."""
    a = spark.read.schema(ANNOTATION).option("multiLine", True).json(path)
    f = a.select(F.col("sequence.name").alias("sequence"), F.col("sequence.fps").alias("fps"), F.explode_outer("frames").alias("f"))
    o = f.select("sequence", "fps", F.col("f.frame_index").alias("frame"), F.col("f.width").alias("width"), F.col("f.height").alias("height"), F.explode_outer("f.objects").alias("o"))
    at = lambda i: F.get("o.bbox", F.lit(i))
    return o.select("sequence", "fps", "frame", "width", "height", "o.track_id", F.col("o.class").alias("class"), at(0).alias("x"), at(1).alias("y"), at(2).alias("w"), at(3).alias("h"), F.col("o.confidence").alias("conf"), "o.visibility")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Detection cache: a row per frame. Files have no order among each other, so repeated frames are left to cache_issues to report."""
    return spark.read.schema(CACHE).json(path)


def cache_rows(cache: DataFrame, threshold: float) -> DataFrame:
    d = cache.select(F.col("sequence_name").alias("sequence"), F.col("frame_index").alias("frame"), F.explode("detections").alias("d")).where(F.col("d.confidence") >= threshold)
    at = lambda i: F.get("d.bbox_xyxy", F.lit(i))
    return d.select("sequence", "frame", at(0).alias("x"), at(1).alias("y"), (at(2) - at(0)).alias("w"), (at(3) - at(1)).alias("h"), F.col("d.confidence").alias("conf"), "d.class_id", "d.class_name")


def write_cache(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """rows of cache_rows() as JSON, a folder for each sequence."""
    d = F.struct("class_id", "class_name", F.col("conf").alias("confidence"), F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("bbox_xyxy"))
    frames = rows.groupBy("sequence", "frame").agg(F.array_sort(F.collect_list(d)).alias("detections"))
    frames.select("sequence", F.col("sequence").alias("sequence_name"), F.col("frame").alias("frame_index"), "detections").write.mode(mode).partitionBy("sequence").json(path)


def read_scalabel(spark: SparkSession, path: str) -> DataFrame:
    """Frames of Scalabel JSON lists: classes numbered from 1 by name, external ids from 1 in order of their first appearance, frame = frameIndex + 1."""
    schema = "name string, videoName string, frameIndex long, labels array<struct<id:string,category:string,box2d:struct<x1:double,y1:double,x2:double,y2:double>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("videoName").alias("sequence"), (F.col("frameIndex") + 1).alias("frame"), F.posexplode("labels").alias("pos", "l"))
    r = f.where("l.box2d is not null").select("sequence", "frame", "pos", "l.id", "l.category", "l.box2d.*")
    names = r.select("category").distinct().withColumn("class_id", F.row_number().over(W.partitionBy().orderBy("category")))  # a row for each class
    ids = r.groupBy("sequence", "id").agg(F.min(F.struct("frame", "pos")).alias("first")).withColumn("track_id", F.row_number().over(W.partitionBy("sequence").orderBy("first")))
    return r.join(F.broadcast(names), "category").join(ids.drop("first"), ["sequence", "id"]).select("sequence", "frame", "track_id", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), "class_id", "category")


def read_coco_video(spark: SparkSession, path: str) -> DataFrame:
    """COCO-style video JSON: annotations with their images, videos and categories; an annotation of an unknown image is dropped, an unknown video keeps its number."""
    schema = "annotations array<struct<id:long,image_id:long,category_id:int,track_id:long,bbox:array<double>>>, images array<struct<id:long,video_id:long,frame_index:long>>, videos array<struct<id:long,name:string>>, categories array<struct<id:int,name:string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    part = lambda name: doc.select(F.explode(name).alias("v")).select("v.*")
    a, i = part("annotations"), part("images").withColumnRenamed("id", "image_id")
    v, c = part("videos").select(F.col("id").alias("video_id"), F.col("name").alias("video")), part("categories").select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    j = a.join(i, "image_id").join(v, "video_id", "left").join(F.broadcast(c), "category_id", "left")
    at = lambda k: F.get("bbox", F.lit(k))
    return j.select(F.coalesce("video", F.col("video_id").cast("string")).alias("sequence"), (F.col("frame_index") + 1).alias("frame"), "track_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("w"), at(3).alias("h"), F.col("category_id").alias("class_id"), "category")


def read_animal_track(spark: SparkSession, path: str, classes: dict[str, int]) -> DataFrame:
    """AnimalTrack text of 8 or more columns; the class is the file's name before its first `_`, numbered by `classes`."""
    r = lines(spark, path).where(F.size("fields") >= 8)
    stem = F.regexp_replace("sequence", "_gt$", "")
    ids = F.create_map(*[F.lit(x) for kv in (classes or {"": 0}).items() for x in kv])
    name = F.regexp_extract(stem, r"^([^_]+)", 1)
    return r.select(stem.alias("sequence"), *[_number(i).cast("long" if i < 2 else "double").alias(c) for i, c in enumerate(FIELDS[:7])], name.alias("category"), ids[name].alias("class_id"))


def read_detrac(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("car", "bus", "van", "others")) -> DataFrame:
    """UA-DETRAC XML: a row for each target; unknown vehicle types are others, visibility is 1 - truncation held to 0 and 1."""
    schema = "_num long, target_list struct<target:array<struct<_id:long,box:struct<_left:double,_top:double,_width:double,_height:double>,attribute:struct<_vehicle_type:string,_truncation_ratio:double>>>>"
    f = spark.read.schema(schema).format("xml").option("rowTag", "frame").load(path).select(_file_stem().alias("sequence"), F.col("_num").alias("frame"), F.explode("target_list.target").alias("t"))
    kind = F.when(F.lower("t.attribute._vehicle_type").isin(*kinds), F.lower("t.attribute._vehicle_type")).otherwise("others")
    return f.select("sequence", "frame", F.col("t._id").alias("track_id"), F.col("t.box._left").alias("x"), F.col("t.box._top").alias("y"), F.col("t.box._width").alias("w"), F.col("t.box._height").alias("h"), kind.alias("category"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("t.attribute._truncation_ratio", F.lit(0.0)))).alias("visibility"))


READERS = {"mot": read_mot, "scalabel": read_scalabel, "coco_video": read_coco_video, "animal_track": read_animal_track, "ua_detrac": read_detrac}


def normalize_gt(spark: SparkSession, source: str, path: str, max_frames: int | None = None, **options) -> DataFrame:
    """Rows of any source format in common columns; sequences left without rows do not occur."""
    rows = READERS[source](spark, path, **options)
    return rows if max_frames is None else rows.where(F.col("frame") <= max_frames)


def yolo_labels(rows: DataFrame, images: DataFrame, digits: int = 6) -> DataFrame:
    """(image, value): the label file of every image, empty where it has no box. rows: image, class_id, x, y, w, h; images: image, width, height."""
    j = images.join(rows, "image", "left")
    x, y = (F.col("x") + F.col("w") / 2) / F.col("width"), (F.col("y") + F.col("h") / 2) / F.col("height")
    text = F.when(F.col("x").isNotNull(), F.format_string(f"%d %.{digits}f %.{digits}f %.{digits}f %.{digits}f", "class_id", x, y, F.col("w") / F.col("width"), F.col("h") / F.col("height")))
    return j.groupBy("image").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("value"))


def write_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    events.write.mode(mode).json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key is not stored yet and returns how many."""
    spark = rows.sparkSession
    try:
        known = spark.read.schema(rows.schema).json(path)
        rows = rows.join(known, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows = rows.dropDuplicates([key])
    n = rows.count()
    rows.write.mode("append").json(path)
    return n


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def cached(rows: DataFrame, cache: DataFrame, columns: list[str], value: str) -> DataFrame:
    """Adds the cached value of each row by the hash of its columns, null for a miss. cache: key, value."""
    return rows.withColumn("key", F.sha2(F.to_json(F.struct(*sorted(columns))), 256)).join(cache.select("key", value), "key", "left")


def check_mot(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """Issues of MOT files, read without failing."""
    rows = lines(spark, path)
    short = rows.where(F.size("fields") < 6).select("sequence", F.lit(None).cast("long").alias("frame"), F.lit(None).cast("long").alias("track_id"), "line_number", F.lit("short_row").alias("code"), F.lit("error").alias("severity"))
    typed = rows.where(F.size("fields") >= 6).withColumns({f: _number(i) for i, f in enumerate(FIELDS[:7])}).withColumns({"frame": F.col("frame").cast("long"), "track_id": F.col("track_id").cast("long")})
    return mot_issues(typed, length).unionByName(short)
