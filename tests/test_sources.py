import json

import pytest
from pyspark.sql import functions as F

from boxtrail.sources import mot


def write(path, text):
    path.write_text(text)
    return str(path)


def test_strict_reader(spark, tmp_path):
    p = write(tmp_path / "seq_1.txt", "1,7,10,20,30,40,0.5,1,1\n\n2,7,11,21,30,40,-1\n")
    got = mot.read_mot(spark, p).orderBy("frame").collect()
    assert [(r.sequence, r.frame, r.track_id, r.x2, r.conf, r.line_number) for r in got] == [("seq_1", 1, 7, 40.0, 0.5, 1), ("seq_1", 2, 7, 41.0, None, 3)]


@pytest.mark.parametrize("text", ["1,7,1,2,3\n", "1.5,7,1,2,3,4\n", "1,7,nan,2,3,4\n", "1,7,1,2,3,4\n1,7,1,2,3,5\n"])
def test_strict_reader_raises(spark, tmp_path, text):
    with pytest.raises(Exception, match="line"):
        mot.read_mot(spark, write(tmp_path / "a.txt", text)).collect()


def test_lenient_reader(spark, tmp_path):
    p = write(tmp_path / "a.txt", "1.9,2.9,1,2,3,4\n1,0,1,2,3,4,1\n1,x,1,2,3,4\n1,2\n2,3,1,2,3,4,0\n")
    assert [(r.frame, r.track_id, r.conf) for r in mot.read_mot_lenient(spark, p).orderBy("line_number").collect()] == [(1, 2, 1.0), (2, 3, 0.0)]
    assert mot.read_mot_lenient(spark, p, ground_truth=True).count() == 1
    assert mot.read_mot_context(spark, p).count() == 2


def test_text_of_rows(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, 7, 50.0, 50.0, 20.0, 15.0, None)], "sequence string, frame long, track_id long, x double, y double, w double, h double, conf double")
    assert mot.mot_text(rows).first().value == "1,7,50.000000,50.000000,20.000000,15.000000,-1.000000,1,1.000000"
    with pytest.raises(Exception, match="repeated"):
        mot.mot_text(rows.union(rows)).collect()
    assert mot.mot_text(rows.union(rows), gt=True).count() == 1
    mot.write_mot(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "sequence=s")).count() == 1


def test_lists_and_info(spark, tmp_path):
    p = write(tmp_path / "seqmap.txt", "name\n\na\\b\\seq_1\nseq_2\n")
    assert {r.sequence for r in mot.read_seqmap(spark, p).collect()} == {"seq_1", "seq_2"}
    info = "[Sequence]\nname=seq_1\nimDir=img1\nframeRate=25\nseqLength=10\nimWidth=100\nimHeight=50\nimExt=.jpg\n"
    (tmp_path / "root" / "seq_1").mkdir(parents=True)
    q = write(tmp_path / "root" / "seq_1" / "seqinfo.ini", info)
    r = mot.read_seqinfo(spark, q).first()
    assert (r.name, r.frameRate, r.seqLength) == ("seq_1", 25.0, 10)
    with pytest.raises(FileNotFoundError):
        mot.discover(spark, str(tmp_path / "root"), mot.read_seqmap(spark, p))
    assert [x.sequence for x in mot.discover(spark, str(tmp_path / "root")).collect()] == ["seq_1"]
    with pytest.raises(Exception, match="seqLength"):
        mot.read_seqinfo(spark, write(tmp_path / "bad.ini", info.replace("seqLength=10\n", ""))).collect()


def test_annotations_and_cache(spark, tmp_path):
    a = {"sequence": {"name": "q", "fps": 25.0, "width": 100, "height": 50, "frame_count": 2}, "frames": [{"frame_index": 1, "width": 100, "height": 50, "objects": [{"track_id": "p1", "class": "car", "bbox": [1, 2, 3, 4], "confidence": 0.5}]}, {"frame_index": 2, "width": 100, "height": 50, "objects": []}]}
    rows = mot.read_annotations(spark, write(tmp_path / "a.json", json.dumps(a, indent=1))).orderBy("frame").collect()
    assert [(r.frame, r.track_id, r.w) for r in rows] == [(1, "p1", 3.0), (2, None, None)]
    det = spark.createDataFrame([("q", 1, 1.0, 2.0, 3.0, 4.0, c, 1, "car") for c in (0.9, 0.2)], "sequence string, frame long, x double, y double, w double, h double, conf double, class_id int, class_name string")
    mot.write_cache(det, str(tmp_path / "cache"))
    back = mot.cache_rows(mot.read_cache(spark, str(tmp_path / "cache")), 0.5).collect()
    assert [(r.sequence, r.frame, r.w, r.conf) for r in back] == [("q", 1, 3.0, 0.9)]


def test_other_formats(spark, tmp_path):
    s = [{"name": "f", "videoName": "v", "frameIndex": 0, "labels": [{"id": "z", "category": "car", "box2d": {"x1": 1, "y1": 2, "x2": 4, "y2": 6}}, {"id": "b", "category": "bus", "box2d": {"x1": 0, "y1": 0, "x2": 1, "y2": 1}}]}]
    got = {(r.track_id, r.class_id, r.frame, r.w) for r in mot.normalize_gt(spark, "scalabel", write(tmp_path / "s.json", json.dumps(s, indent=1))).collect()}
    assert got == {(1, 2, 1, 3.0), (2, 1, 1, 1.0)}
    c = {"annotations": [{"id": 1, "image_id": 5, "category_id": 2, "track_id": 9, "bbox": [1, 2, 3, 4]}, {"id": 2, "image_id": 6, "category_id": 2, "track_id": 9, "bbox": [1, 2, 3, 4]}], "images": [{"id": 5, "video_id": 8, "frame_index": 0}], "videos": [], "categories": [{"id": 2, "name": "cat"}]}
    (r,) = mot.read_coco_video(spark, write(tmp_path / "c.json", json.dumps(c, indent=1))).collect()
    assert (r.sequence, r.frame, r.category) == ("8", 1, "cat")
    x = '<sequence><frame num="3"><target_list><target id="1"><box left="1" top="2" width="3" height="4"/><attribute vehicle_type="Tram" truncation_ratio="0.25"/></target></target_list></frame></sequence>'
    (r,) = mot.read_detrac(spark, write(tmp_path / "MVI_1.xml", x)).collect()
    assert (r.sequence, r.frame, r.track_id, r.category, r.visibility) == ("MVI_1", 3, 1, "others", 0.75)
    (r,) = mot.read_animal_track(spark, write(tmp_path / "deer_1_gt.txt", "1,2,3,4,5,6,1,1\n1,2,3\n"), {"deer": 4}).collect()
    assert (r.sequence, r.category, r.class_id) == ("deer_1", "deer", 4)


def test_yolo_labels_events_and_hashes(spark, tmp_path):
    images = spark.createDataFrame([("a", 100, 50), ("b", 100, 50)], "image string, width int, height int")
    rows = spark.createDataFrame([("a", 0, 10.0, 10.0, 20.0, 10.0)], "image string, class_id int, x double, y double, w double, h double")
    assert {r.image: r.value for r in mot.yolo_labels(rows, images).collect()} == {"a": "0 0.200000 0.300000 0.200000 0.200000", "b": ""}
    e = spark.createDataFrame([("e1", "s", 1, "A", "high", 1, 2, 1)], mot.EVENT)
    mot.write_events(e, str(tmp_path / "log"))
    assert mot.append_new(e, str(tmp_path / "log"), "event_id") == 0
    assert mot.append_new(e.withColumn("event_id", F.lit("e2")), str(tmp_path / "log"), "event_id") == 1
    assert mot.read_events(spark, str(tmp_path / "log")).count() == 2
    assert mot.append_new(e, str(tmp_path / "new"), "event_id") == 1
    assert all(len(r.sha256) == 64 for r in mot.file_hashes(spark, str(tmp_path / "log")).collect())


def test_check_reports_every_fault(spark, tmp_path):
    p = write(tmp_path / "a.txt", "1,1,0,0,5,5,0.5\n1,1,0,0,5,5,0.5\n1,2\n0,3,0,0,0,5,2\n")
    assert {(r.line_number, r.code) for r in mot.check_mot(spark, p).collect()} == {(2, "duplicate"), (3, "short_row"), (4, "bad_frame"), (4, "bad_box"), (4, "bad_confidence"), (4, "unordered")}
