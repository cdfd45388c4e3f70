"""Recordings, logs and records: what is read, and what is set aside with a reason."""

import struct

import numpy as np
import pytest

from strata.plans.files import dzt_bytes, mala_bytes, segy_bytes, spr_bytes
from strata.sources import export, ingest

BLOCK = np.arange(5 * 16, dtype=float).reshape(5, 16) / 1000


def test_segy_positions_spacing_and_byte_order():
    line = ingest.segy(segy_bytes(BLOCK))
    assert np.allclose(line["samples"], BLOCK) and line["dt"] == 0.2 and line["spacing"] == pytest.approx(0.025) and line["xy"].shape == (5, 2)
    head = bytearray(3600)
    for at, value in ((16, 400), (20, 4), (24, 3)):
        struct.pack_into(">h", head, 3200 + at, value)
    big = bytes(head) + (bytes(240) + np.array([1, -2, 3, -4], ">i2").tobytes()) * 3
    line = ingest.segy(big)
    assert line["samples"].tolist() == [[1, -2, 3, -4]] * 3 and line["dt"] == 0.4 and line["spacing"] is None and line["xy"] is None


def test_dzt_marks_are_overwritten_and_dielectric_kept_in_range():
    line = ingest.dzt(dzt_bytes(BLOCK))
    assert (line["samples"][:, 0] == line["samples"][:, 2]).all() and line["dielectric"] == 9.0 and line["spacing"] == 0.025
    raw = bytearray(dzt_bytes(BLOCK))
    struct.pack_into("<H", raw, 52, 2)
    with pytest.raises(ingest.Unreadable):
        ingest.dzt(bytes(raw))


def test_spr_reads_its_header_and_refuses_ragged_records():
    line = ingest.spr(spr_bytes(BLOCK))
    assert line["header"]["NOTE"] == "" and line["dt"] == 0.2 and line["dielectric"] == 9.0
    with pytest.raises(ingest.Unreadable):
        ingest.spr(spr_bytes(BLOCK) + b"\x00")


def test_unreadable_files_become_rows_with_a_reason(spark):
    files = spark.createDataFrame([("good.sgy", bytearray(segy_bytes(BLOCK))), ("bad.sgy", bytearray(b"nothing"))], "path string, content binary")
    rows = ingest.decode(files, "segy").collect()
    assert [r["error"] is None for r in rows if r["path"] == "good.sgy"] == [True] * 5
    assert [r["error"] for r in rows if r["path"] == "bad.sgy"] == ["too short for SEG-Y"]


def test_mala_needs_its_header(spark):
    data = bytearray(mala_bytes(BLOCK))
    files = spark.createDataFrame([("a.rd3", data), ("a.rad", bytearray(b"SAMPLES:16\nFREQUENCY:5000")), ("b.rd3", data)], "path string, content binary")
    rows = ingest.decode(ingest.with_mala_headers(files), "mala").collect()
    assert sum(r["error"] is None for r in rows) == 5 and [r["path"] for r in rows if r["error"]] == ["b.rd3"]


def test_xta_refuses_an_irregular_grid(spark):
    good, bad = b"0 0 1\n0 1 2\n1 0 3\n1 1 4\n", b"0 0 1\n0 1 2\n1 0 3\n1 2 4\n"
    traces, refused = ingest.read_xta(spark.createDataFrame([("g", bytearray(good)), ("b", bytearray(bad))], "path string, content binary"))
    got = {r["trace"]: (r["samples"], r["dt"], r["spacing"]) for r in traces.collect()}
    assert got == {0: ([1.0, 2.0], 1.0, 1.0), 1: ([3.0, 4.0], 1.0, 1.0)}
    assert [r["path"] for r in refused.collect()] == ["b"]


def test_logs_records_and_tables_from_disk(spark, tmp_path):
    (tmp_path / "job").mkdir()
    (tmp_path / "job" / "gps.csv").write_text("x,3,12.9,77.5\nx,oops,1,1\nx,4,0,0\n")
    fixes = ingest.read_gps_logs(spark, str(tmp_path / "job" / "gps.csv")).collect()
    assert [(r["line_id"], r["trace"]) for r in fixes] == [("job", 3)]
    (tmp_path / "meta.csv").write_text("﻿LocationID;eps\n1;9\n", encoding="utf-8")
    assert ingest.read_survey_metadata(spark, str(tmp_path / "meta.csv")).first().asDict() == {"LocationID": "1", "eps": "9"}
    (tmp_path / "ok.json").write_text('[{"report_id": "1", "item_id": "a#1", "outcome": "found"}]')
    assert ingest.read_records(spark, "field_reports", str(tmp_path / "ok.json")).count() == 1
    (tmp_path / "bad.json").write_text('[{"report_id": ')
    with pytest.raises(Exception):
        ingest.read_records(spark, "field_reports", str(tmp_path / "bad.json")).collect()
    out = str(tmp_path / "out")
    export.write_csv(spark.createDataFrame([("=1+1", 2.0)], "label string, x double"), out, {"x": 2})
    assert spark.read.option("header", "true").csv(out).first().asDict() == {"label": "'=1+1", "x": "2.00"}


def test_folder_intake(spark, tmp_path):
    for name in ("a.sgy", "b.txt", "._c.sgy", "noext"):
        (tmp_path / name).write_bytes(b"x")
    good, bad = ingest.intake(ingest.read_files(spark, str(tmp_path)).select("path"))
    assert [r["path"].rsplit("/", 1)[1] for r in good.collect()] == ["a.sgy"]
    assert sorted(r["path"].rsplit("/", 1)[1] for r in bad.collect()) == ["b.txt", "noext"]
