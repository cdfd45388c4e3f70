"""Split recordings, record stores and tables: what is read, by how many tasks, and what is refused with a reason."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.plans.files import dzt_bytes, mala_bytes, segy_bytes, spr_bytes
from strata.sources import radar, records

BLOCK = np.random.default_rng(2).normal(size=(300, 32)).clip(-3, 3).round(4)


@pytest.fixture(scope="module")
def recordings(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("lines")
    (base / "deep").mkdir()
    files = {"a.sgy": segy_bytes(BLOCK), "deep/b.dzt": dzt_bytes(BLOCK), "c.rd3": mala_bytes(BLOCK), "c.rad": b"SAMPLES:32\nFREQUENCY:5000\nDISTANCE INTERVAL: 2.5e-02\n",
             "deep/d.rad": spr_bytes(BLOCK), "bad.sgy": b"nothing", "lost.rd7": mala_bytes(BLOCK), "._a.sgy": b"x", "note.txt": b"x"}
    for name, data in files.items():
        (base / name).write_bytes(data)
    radar.register(spark)
    return str(base)


def traces(spark, path, split):
    return spark.read.format("radar").option("splitBytes", split).load(path)


@pytest.mark.parametrize("split", [5000, 32 << 20])
def test_each_format_gives_its_traces_whatever_the_split(spark, recordings, split):
    rows = traces(spark, recordings, split).withColumn("name", F.element_at(F.split("path", "/"), -1)).orderBy("name", "trace").collect()
    by = {}
    for r in rows:
        by.setdefault(r["name"], []).append(r)
    assert {n: (len(v), v[0]["error"]) for n, v in by.items()} == {
        "a.sgy": (300, None), "b.dzt": (300, None), "c.rd3": (300, None), "d.rad": (300, None), "bad.sgy": (1, "too short for SEG-Y"), "lost.rd7": (1, "its .rad header is missing")}
    want = {"a.sgy": BLOCK, "c.rd3": np.rint(BLOCK * 1e4), "d.rad": np.rint(BLOCK * 1e4), "b.dzt": np.rint(BLOCK * 1e6)}
    for name, block in want.items():
        got = np.array([r["samples"] for r in by[name]])
        assert [r["trace"] for r in by[name]] == list(range(300))
        skip = 2 if name == "b.dzt" else 0
        assert np.allclose(got[:, skip:], block[:, skip:], rtol=1e-6)
        assert {(round(r["dt"], 6), round(r["spacing"], 6)) for r in by[name]} == {(0.2, 0.025)}
    assert (by["b.dzt"][5]["samples"][0] == by["b.dzt"][5]["samples"][2]) and by["b.dzt"][0]["dielectric"] == 9.0
    assert (by["a.sgy"][7]["x"], by["a.sgy"][7]["y"]) == pytest.approx((10.14, 50.035)) and by["c.rd3"][0]["x"] is None


def test_one_file_is_read_by_many_tasks(spark, recordings):
    df = traces(spark, f"{recordings}/a.sgy", 8000)
    assert df.rdd.getNumPartitions() >= 10
    shares = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 300 and max(shares) < 60


def test_a_broken_record_far_inside_a_file_is_told(spark, tmp_path):
    data = bytearray(spr_bytes(BLOCK))
    struct.pack_into("<H", data, len(data) - 128 + 2, 63)
    (tmp_path / "x.ra1").write_bytes(bytes(data))
    rows = traces(spark, str(tmp_path), 32 << 20).filter("error IS NOT NULL").collect()
    assert [r["error"] for r in rows] == ["a record declares another header length"]


def test_a_users_own_format_is_one_function(spark, tmp_path):
    @radar.layout("own")
    def own(head, size, side):
        (n,) = struct.unpack_from("<I", head)
        return radar.whole(radar.Plan(4, np.dtype([("amp", "<f4", (n,))]), 0.5), size)

    try:
        radar.register(spark)
        (tmp_path / "x.own").write_bytes(struct.pack("<I", 4) + np.arange(12, dtype="<f4").tobytes())
        rows = traces(spark, str(tmp_path), 20).orderBy("trace").collect()
        assert [r["samples"] for r in rows] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    finally:
        del radar.LAYOUTS["own"]
        radar.register(spark)
    assert traces(spark, str(tmp_path), 20).count() == 0


@pytest.mark.parametrize("text, value", [("0.025", 0.025), (".05", 0.05), ("2.5e-02", 0.025), ("5.", 5.0), ("-1", -1.0), ("1,5", None), ("", None), (None, None), ("1 m", None)])
def test_numbers_of_headers(text, value):
    assert radar.number(text) == value


# ---------------------------------------------------------------- record stores


REPORT = {"id": "1", "item_id": "a#1", "outcome": "found", "reporter": "x", "note": "", "reported_at": "2024", "lat": None, "lon": None, "accuracy_m": None}


def test_record_stores_give_rows_of_good_files_and_reasons_of_others(spark, tmp_path):
    def put(job, text):
        (tmp_path / job).mkdir()
        (tmp_path / job / "field_reports.json").write_text(text if isinstance(text, str) else json.dumps(text))

    put("good", {"version": 2, "reports": [REPORT, {**REPORT, "id": "2", "depth_found_m": 1.5}]})
    put("none", {"reports": []})
    put("cut", '{"reports": [{"id": ')
    put("other", {"records": []})
    put("list", [REPORT])
    put("kind", {"reports": [REPORT, {**REPORT, "lat": "north"}]})
    put("lacks", {"reports": [{k: v for k, v in REPORT.items() if k not in ("note", "id")}]})
    put("more", {"reports": [{**REPORT, "photo": "p"}]})
    put("text", {"reports": ["x"]})
    good, refused = records.read_record_store(spark, "field_reports", str(tmp_path))
    assert sorted((r["job"], r["no"], r["version"], r["id"], r["depth_found_m"]) for r in good.collect()) == [("good", 0, 2, "1", None), ("good", 1, 2, "2", 1.5)]
    assert {r["path"].split("/")[-2]: r["reason"] for r in refused.collect()} == {
        "cut": "not JSON", "other": 'no list of "reports"', "list": 'no list of "reports"', "kind": "record 1 has a value of another type",
        "lacks": "record 0 lacks id, note", "more": "record 0 has unknown photo", "text": "record 0 is no object"}


def test_texts_that_are_nothing_are_refused_too(spark):
    files = spark.createDataFrame([("a/1/picks.json", ""), ("a/2/picks.json", None), ("a/3/picks.json", "[]"), ("a/4/picks.json", "null")], "path string, text string")
    good, refused = records.parse_records(files, "picks")
    assert good.count() == 0 and sorted(r["path"][2] for r in refused.collect()) == ["1", "2", "3", "4"]


def test_absent_fields_have_their_meaning(spark):
    box = {"id": "b", "channel": "RAD", "x": 1, "y": 2.5, "w": 3, "h": 4}
    files = spark.createDataFrame([("r/job7/boxes.json", json.dumps({"boxes": [box]}))], "path string, text string")
    good, refused = records.parse_records(files, "boxes")
    row = good.first()
    assert refused.count() == 0 and (row["job"], row["x"], row["note"], row["detector"], row["version"]) == ("job7", 1.0, "", None, None)


def test_metadata_and_exchange_tables(spark, tmp_path):
    text = "﻿LocationID;eps; soil\r\n1;9;sand\r\n2;12\r\n1;8;clay\r\n;3;x\r\n"
    files = spark.createDataFrame([("m.csv", text), ("n.csv", "LocationID;eps")], "path string, text string")
    rows = {r["location_id"]: r["fields"] for r in records.parse_metadata(files).collect()}
    assert rows["1"] == {"LocationID": "1", "eps": "8", "soil": "clay"} and rows["2"] == {"LocationID": "2", "eps": "12", "soil": None}
    (tmp_path / "points.csv").write_text('lat,drawing,sheet,chainage_m,lon\n12.5,"A, Rhs.pdf",1,100.5,77.1\nn/a,B,x,,77\n')
    got = [tuple(r) for r in records.read_table(spark, str(tmp_path / "points.csv"), records.POINT_TABLE).collect()]
    assert got == [("A, Rhs.pdf", 1, 100.5, 12.5, 77.1), ("B", None, None, None, 77.0)]
    lines = spark.createDataFrame([('"A, Rhs.pdf",1,100.5,12.5,77.1',), ("B,x,,n/a,77",)], "value string")
    assert [tuple(r) for r in records.parse_table(lines, records.POINT_TABLE).collect()] == got
