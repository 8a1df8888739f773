import datetime
import os
import zlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimenta.operators import compaction as c
from tests.conftest import rows

TS = datetime.datetime(2025, 1, 1)
SCANS = "scan_id long, table_id long, mp_list array<long>, mp_id string"
FILES = "mp_id long, table_id long, schema_id long, active boolean, loaded_at timestamp, records long"
CONFIGS = "schema_id long, enabled boolean, merge_enabled boolean, merge_min_mps long, merge_target_rows long, updated_at timestamp"
RECORDS = "mp_id long, row_ordinal int, table_id long, id long, name string, amount double, written_at timestamp, line string, r int"


def tables(spark, scans, files, configs, records):
    return (spark.createDataFrame(scans, SCANS), spark.createDataFrame(files, FILES), spark.createDataFrame(configs, CONFIGS), spark.createDataFrame(records, RECORDS))


def small_case(spark):
    scans = [(1, 7, [1, 1, 2, 3, None], "x"), (2, 7, [2, 4, 99], "x"), (3, 8, [5], None), (4, None, [1], None), (5, 7, None, None)]
    files = [(i, 7, 0, True, TS, 5) for i in (1, 2, 3)] + [(4, 7, 0, False, TS, 1), (4, 7, 0, True, TS - datetime.timedelta(1), 1), (5, 8, 0, True, TS, None), (None, 7, 0, True, TS, None)]
    configs = [(None, True, True, 2, 10, TS), (0, True, None, None, 8, TS), (0, False, None, None, 8, TS - datetime.timedelta(9))]
    records = [(1, i, 7, i, None if i else "a", -0.0, TS, "l", 1) for i in range(3)] * 2 + [(2, i, 7, i, "b", None, TS, None, None) for i in range(4)] + [(3, None, 7, 1, None, None, TS, None, None), (1, 0, 7, 100, "later", 1.5, TS + datetime.timedelta(1), None, None)]
    return tables(spark, scans, files, configs, records)


def test_plan_takes_small_active_listed_files(spark):
    plan = c.plan_compaction(*small_case(spark))
    # File 2 holds 4 records, half of the target of 8; 3 has none; 4 is inactive now and 5 is alone.
    assert rows(plan.select("table_id", "mp_id", "records", "target_rows")) == [(7, 1, 3, 8), (7, 3, 0, 8)]


def test_merged_files_hold_each_record_once(spark):
    merged = c.compact(*small_case(spark))
    (one,) = merged.collect()
    assert one["records"] == 3 and zlib.crc32(one["data"]) == one["crc"] and [m["mp_id"] for m in one["members"]] == [1, 3]
    schema = spark.createDataFrame([], RECORDS).schema
    got = rows(c.decode_merged(merged, schema).select("mp_id", "row_ordinal", "id", "name", "amount"))
    assert got == [(1, 0, 100, "later", 1.5), (1, 1, 1, None, -0.0), (1, 2, 2, None, -0.0)]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_records_come_back_unchanged(spark, kind):
    scans, files, configs, _ = small_case(spark)
    at = datetime.datetime(2025, 1, 1, 2, 3, 4, 123456)
    names = ["a\u0085b", "a\u2028b", "a\u2029b", "a\nb\r\nc", "a\x0b\x0c\x1c\x1d\x1eb", "", " \"\\ "]
    stored = [(1 if i < 3 else 3, i % 3 if i < 3 else i - 3, 7, i, name, float("inf") if i else None, at + datetime.timedelta(microseconds=i)) for i, name in enumerate(names[:6])]
    records = spark.createDataFrame(stored + [(3, 9, 7, 9, names[6], -0.0, datetime.datetime(1850, 1, 1, 0, 0, 0, 1))], f"mp_id long, row_ordinal int, table_id long, id long, name string, amount double, written_at {kind}")
    configs = configs.withColumn("merge_target_rows", F.lit(100).cast("long"))
    merged = c.compact(scans, files, configs, records)
    assert rows(c.decode_merged(merged, records.schema)) == rows(records)


def test_empty_tables(spark):
    assert c.compact(*tables(spark, [], [], [], [])).collect() == []


def test_changed_frame_is_found(spark):
    plan = c.plan_compaction(*small_case(spark))
    frames = c.encode_frames(small_case(spark)[3], plan).withColumn("crc", c.F.lit(1).cast("long"))
    with pytest.raises(Exception, match="changed since"):
        c.merge_frames(plan, frames).collect()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=6))
def test_frame_spans_and_join(parts):
    frames = [zstandard.ZstdCompressor(write_checksum=i % 2 == 0).compress(p) for i, p in enumerate(parts)]
    joined = b"".join(c.join_frames(frames))
    spans = c.frame_spans(joined)
    assert len(spans) == len(parts) and b"".join(zstandard.ZstdDecompressor().decompress(joined[a:b], max_output_size=1 << 20) for a, b in spans) == b"".join(parts)
    if joined:
        with pytest.raises(c.CompactionError):
            c.frame_spans(joined[:-1])
        with pytest.raises(c.CompactionError):
            c.frame_spans(b"\0" + joined)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab ", max_size=5), max_size=4), max_size=5), st.booleans(), st.booleans())
def test_join_lines_keeps_every_record(files, last_newline, header):
    head = ["h,1"] if header else []
    parts = [("\n".join(head + lines) + ("\n" if last_newline or not lines else "")).encode() if head + lines else b"" for lines in files]
    joined = b"".join(c.join_lines(parts, b"h,1" if header else None)).decode()
    wanted = (head if any(parts) else []) + [x for p in parts for x in p.decode().split("\n")[len(head) : len(p.decode().split("\n")) - p.decode().endswith("\n")] if p]
    assert joined == "".join(x + "\n" for x in wanted)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=400), max_size=5), st.integers(1, 30), st.data())
def test_frames_are_walked_in_pieces(parts, step, data):
    joined = b""
    for i, p in enumerate(parts):
        joined += zstandard.ZstdCompressor(write_checksum=i % 2 == 0, write_content_size=i % 3 > 0).compress(p)
        joined += b"\x50\x2a\x4d\x18" + len(p).to_bytes(4, "little") + p if i % 2 else b""
    pieces = lambda d: [d[i : i + step] for i in range(0, len(d), step)]
    assert b"".join(c.join_frame_pieces([pieces(joined), [], pieces(joined)])) == joined * 2
    walk = c.FrameWalk()
    for piece in pieces(joined):
        walk.feed(piece)
    assert walk.finish() == len(c.frame_spans(joined))
    if joined:
        cut = data.draw(st.integers(1, len(joined) - 1))
        if cut not in [b for _, b in c.frame_spans(joined)]:
            with pytest.raises(c.CompactionError):
                list(c.join_frame_pieces([pieces(joined[:cut])]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="h,1\nb", max_size=12), max_size=5), st.integers(1, 5), st.booleans())
def test_lines_in_pieces_equal_whole_parts(files, step, header):
    parts = [f.encode() for f in files]
    top = b"h,1" if header else None
    assert b"".join(c.join_line_pieces([[p[i : i + step] for i in range(0, len(p), step)] for p in parts], top)) == b"".join(c.join_lines(parts, top))


def test_large_files_can_stay(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, n in enumerate([5, 900, 7, 9]):
        (source / f"{i}.txt").write_text("x\n" * n)
    out = rows(c.compact_files(spark, f"file://{source}", f"file://{tmp_path}/out", "lines", 1000, leave_large=True))
    assert [(r[1], r[2], r[3] is None) for r in out] in ([(3, 42, False), (1, 1800, True)], [(1, 1800, True), (3, 42, False)]) and os.listdir(tmp_path / "out")


def test_plan_is_small(spark):
    plan = c.compact(*small_case(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 12


def test_folder_of_files(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i in range(30):
        (source / f"{i:02d}.csv").write_text("id,v\n" + "".join(f"{i},{j}\n" for j in range(i)) + ("" if i % 2 else f"{i},last"))
    (source / "empty.csv").write_text("")
    out = c.compact_files(spark, f"file://{source}", f"file://{target}", "lines", 200, b"id,v").collect()
    assert sum(r["parts"] for r in out) == 30 and 1 < len(out) < 20
    lines = [x for f in sorted(os.listdir(target)) for x in (target / f).read_text().split("\n")[1:-1]]
    assert sorted(lines) == sorted([f"{i},{j}" for i in range(30) for j in range(i)] + [f"{i},last" for i in range(0, 30, 2)])
    frames = tmp_path / "z"
    frames.mkdir()
    for i in range(5):
        (frames / f"{i}.zst").write_bytes(zstandard.compress(f"{i}\n".encode()))
    (one,) = c.compact_files(spark, f"file://{frames}", f"file://{tmp_path / 'zo'}", "zstd", 1 << 20).collect()
    with zstandard.open(one["path"].removeprefix("file://"), "rb") as f:
        data = f.read() if False else b"".join(zstandard.ZstdDecompressor().decompress(open(one["path"].removeprefix("file://"), "rb").read()[a:b]) for a, b in c.frame_spans(open(one["path"].removeprefix("file://"), "rb").read()))
    assert data == b"0\n1\n2\n3\n4\n"
    with pytest.raises(ValueError):
        c.compact_files(spark, str(source), str(target), "tar")
