"""Small-file compaction by byte-level concatenation.

Files are never decoded to be merged. Newline-delimited parts are joined at record boundaries (a missing last newline
is added, a repeated header line is dropped), zstandard parts are joined as complete frames, and every merged file is
checked against the lengths, checksums and record counts of its parts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sedimenta.operators.common import current_rows, staged
from sedimenta.sources.store import open_uri, qualified

ZSTD_MAGIC = 0xFD2FB528
SKIPPABLE_MAGIC = 0x184D2A50  # low four bits free
FRAME_ROWS = 65_536  # records in one frame; longer files are sequences of frames
PACK_FILES = 10_000  # files packed by one task
# Times in stored records keep their microseconds, and their offset to the second.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

MEMBER = T.StructType(
    [
        T.StructField("mp_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("records", T.LongType()),
    ]
)


class CompactionError(Exception):
    """A part or a merged file does not match its recorded length, checksum or record count."""


def frame_spans(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of each complete zstandard frame, found from frame and block headers without decompressing.

    Raises CompactionError on a foreign magic number, a truncated frame or trailing bytes.
    """
    spans, at, end = [], 0, len(data)
    while at < end:
        if end - at < 8:
            raise CompactionError(f"truncated frame header at byte {at}")
        (magic,) = struct.unpack_from("<I", data, at)
        start = at
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic == ZSTD_MAGIC:
            flags = data[at + 4]
            single = flags >> 5 & 1
            size_bytes = (single, 2, 4, 8)[flags >> 6]
            at += 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + size_bytes
            last = False
            while not last:
                if at + 3 > end:
                    raise CompactionError("truncated block header")
                head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
                last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
                if kind == 3:
                    raise CompactionError("reserved block type")
                at += 3 + (1 if kind == 1 else size)
            at += 4 * (flags >> 2 & 1)
        else:
            raise CompactionError(f"not a zstandard frame at byte {start}")
        if at > end:
            raise CompactionError("truncated frame")
        spans.append((start, at))
    return spans


def join_line_pieces(files: Iterable[Iterable[bytes]], header: bytes | None = None) -> Iterator[bytes]:
    """Pieces of one newline-delimited file from files that come in pieces themselves; see join_lines."""
    first = True
    for pieces in files:
        start: bytes | None = b""
        last = b""
        for piece in pieces:
            if start is not None:
                # Enough of the beginning to tell a header line and its end.
                start += piece
                if header is not None and len(start) < len(header) + 2:
                    continue
                piece, start = _without_header(start, header, first), None
            if piece:
                first, last = False, piece[-1:]
                yield piece
        if start:
            piece = _without_header(start, header, first)
            if piece:
                first, last = False, piece[-1:]
                yield piece
        if last and last != b"\n":
            yield b"\n"


def _without_header(start: bytes, header: bytes | None, first: bool) -> bytes:
    """The beginning of a file without its header line, unless nothing was written before."""
    if header is None or first or start[: len(header)] != header:
        return start
    rest = start[len(header) :]
    return rest[1:] if rest[:1] in (b"\n", b"") else rest[2:] if rest[:2] == b"\r\n" else start


def join_lines(parts: Iterable[bytes], header: bytes | None = None) -> Iterator[bytes]:
    """Pieces of one newline-delimited file: each part ends with a newline, a header line is kept once."""
    return join_line_pieces(([part] if part else [] for part in parts), header)


class FrameWalk:
    """Follows the frames of a file that comes in pieces by their headers, whatever its size; finish() needs complete ones."""

    def __init__(self) -> None:
        self.frames, self._at, self._have, self._skip, self._blocks, self._tail = 0, 0, b"", 0, False, 0

    def feed(self, piece: bytes) -> None:
        at = 0
        while at < len(piece):
            if self._skip:
                step = min(self._skip, len(piece) - at)
                self._skip -= step
                at += step
                continue
            need = 3 if self._blocks else 8 if len(self._have) < 8 else self._header()
            take = piece[at : at + need - len(self._have)]
            self._have += take
            at += len(take)
            if len(self._have) == need:
                self._known()
        self._at += len(piece)

    def _header(self) -> int:
        flags = self._have[4]
        single = flags >> 5 & 1
        return 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]

    def _known(self) -> None:
        have = self._have
        if self._blocks:
            head = have[0] | have[1] << 8 | have[2] << 16
            if head >> 1 & 3 == 3:
                raise CompactionError("reserved block type")
            self._skip = 1 if head >> 1 & 3 == 1 else head >> 3
            if head & 1:
                self._blocks, self.frames = False, self.frames + 1
                self._skip += self._tail
            self._have = b""
            return
        (magic,) = struct.unpack_from("<I", have)
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            self._skip, self._have, self.frames = struct.unpack_from("<I", have, 4)[0], b"", self.frames + 1
        elif magic != ZSTD_MAGIC:
            raise CompactionError(f"not a zstandard frame near byte {self._at}")
        elif (size := self._header()) <= len(have):
            # A short header: what is left of the eight bytes read belongs to the first block.
            self._blocks, self._tail, self._have = True, 4 * (have[4] >> 2 & 1), b""
            self.feed_rest(have[size:])

    def feed_rest(self, rest: bytes) -> None:
        at, self._at = self._at, 0
        self.feed(rest)
        self._at = at

    def finish(self) -> int:
        """The number of frames; CompactionError if the last one is cut short."""
        if self._have or self._skip or self._blocks:
            raise CompactionError("truncated frame")
        return self.frames


def join_frame_pieces(files: Iterable[Iterable[bytes]]) -> Iterator[bytes]:
    """Pieces of one multi-frame file from files that come in pieces: every file has to consist of complete frames."""
    for pieces in files:
        walk = FrameWalk()
        for piece in pieces:
            walk.feed(piece)
            yield piece
        walk.finish()


def join_frames(parts: Iterable[bytes]) -> Iterator[bytes]:
    """Pieces of one multi-frame file: every part has to consist of complete frames."""
    for part in parts:
        frame_spans(part)
        yield part


def plan_compaction(scans: DataFrame, partitions: DataFrame, configs: DataFrame, records: DataFrame) -> DataFrame:
    """The files to merge: (table_id, mp_id, records, target_rows, pack).

    A table's files are the distinct ids in its scan lists whose current row is active and of that table. The newest
    setting of a schema holds; null settings and schemas without a row take the default row's value. A table qualifies
    with at least merge_min_mps files, and its files of fewer than half of merge_target_rows distinct ordinals are
    merged if there are two or more. Files without any record count as empty, null lists and null ids name no file,
    and a setting that is null in the default row too switches merging off.
    """
    current = current_rows(partitions, "mp_id", ["mp_id", "table_id", "schema_id", "active", "loaded_at"]).where("active").select("mp_id", "table_id", "schema_id")
    listed = scans.select("table_id", F.explode("mp_list").alias("mp_id")).where("table_id is not null and mp_id is not null").distinct()
    files = staged(listed.join(current, ["table_id", "mp_id"]), "files")

    names = ["enabled", "merge_enabled", "merge_min_mps", "merge_target_rows"]
    newest = configs.groupBy("schema_id").agg(F.max(F.struct("updated_at", *names)).alias("c")).select("schema_id", *[F.col(f"c.{n}").alias(n) for n in names])
    newest = staged(newest, "settings")
    default = newest.where("schema_id is null").select(*[F.col(n).alias(f"d_{n}") for n in names])
    # One row per table and schema: the settings meet these, not the files.
    tables = files.groupBy("table_id", "schema_id").agg(F.count(F.lit(1)).alias("own")).withColumn("files", F.sum("own").over(Window.partitionBy("table_id")))
    able_tables = (
        tables.join(newest.withColumnRenamed("schema_id", "of"), F.col("schema_id").eqNullSafe(F.col("of")), "left")
        .join(F.broadcast(default.limit(1)), F.lit(True), "left")
        .select("table_id", F.col("schema_id").alias("of"), "files", *[F.coalesce(n, f"d_{n}").alias(n) for n in names])
        .where("enabled and merge_enabled and merge_min_mps is not null and merge_target_rows is not null and files >= merge_min_mps")
        .select(F.col("table_id").alias("able_id"), "of", "merge_target_rows")
    )
    able = staged(files.join(able_tables, (files.table_id == F.col("able_id")) & files.schema_id.eqNullSafe(F.col("of"))).select("table_id", "mp_id", "merge_target_rows"), "able")

    # This pass reads two columns; distinct (file, ordinal) first, so that no task sees all records of one large file.
    stored = records.select("mp_id", "row_ordinal").where("mp_id is not null and row_ordinal is not null").join(able.select("mp_id"), "mp_id", "left_semi")
    counts = stored.distinct().groupBy("mp_id").agg(F.count(F.lit(1)).alias("records"))
    small = staged(able.join(counts, "mp_id", "left").withColumn("records", F.coalesce("records", F.lit(0))).where("records * 2 < merge_target_rows"), "small")
    several = small.groupBy("table_id").agg(F.count(F.lit(1)).alias("small_files")).where("small_files >= 2")
    chosen = small.join(several, "table_id")
    # A table with very many small files is packed in independent slices of about PACK_FILES files.
    slices = F.ceil(F.col("small_files") / PACK_FILES)
    return chosen.select("table_id", "mp_id", "records", F.col("merge_target_rows").alias("target_rows"), F.pmod(F.xxhash64("mp_id"), slices).cast("int").alias("pack"))


def bin_pack(plan: DataFrame) -> DataFrame:
    """Adds `bin`: consecutive files of a slice whose running record count falls into the same multiple of the target."""
    before = Window.partitionBy("table_id", "pack").orderBy("mp_id").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum("records").over(before), F.lit(0))
    return plan.withColumn("bin", F.floor(filled / F.greatest("target_rows", F.lit(1))).cast("long"))


def encode_frames(records: DataFrame, files: DataFrame) -> DataFrame:
    """(mp_id, frame_no, frame, bytes, crc, records): the stored records of the given files as zstandard frames of JSON lines.

    A record written more than once is stored once, as last written. A frame covers FRAME_ROWS ordinals, so a group is
    bounded however large its file is. Records are exchanged once, by frame; finding the last written ones and putting
    frames together both work on that.
    """
    kept = records.where("mp_id is not null and row_ordinal is not null").join(files.select("mp_id"), "mp_id", "left_semi")
    rest = [c for c in kept.columns if c not in ("mp_id", "row_ordinal", "written_at")]
    by_frame = kept.withColumn("__frame", F.floor(F.col("row_ordinal") / FRAME_ROWS).cast("long")).repartition("mp_id", "__frame")
    stored = by_frame.groupBy("mp_id", "__frame", "row_ordinal").agg(F.max(F.struct("written_at", *rest)).alias("r"))
    line = F.to_json(F.struct("mp_id", "row_ordinal", *[F.col(f"r.{c}").alias(c) for c in ["written_at", *rest]]), TIMES)
    chunks = (
        stored.select("mp_id", F.col("__frame").alias("frame_no"), F.struct("row_ordinal", line.alias("line")).alias("l"))
        .groupBy("mp_id", "frame_no")
        .agg(F.sort_array(F.collect_list("l")).alias("ls"))
        .select("mp_id", "frame_no", F.size("ls").cast("long").alias("records"), F.concat(F.array_join(F.col("ls.line"), "\n"), F.lit("\n")).alias("body"))
    )

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        for batch in batches:
            frames = [packer.compress(body.as_buffer()) for body in batch.column("body")]
            yield pa.record_batch(
                [batch.column("mp_id"), batch.column("frame_no"), pa.array(frames, pa.binary()), pa.array([len(f) for f in frames], pa.int64()), pa.array([zlib.crc32(f) for f in frames], pa.int64()), batch.column("records")],
                names=["mp_id", "frame_no", "frame", "bytes", "crc", "records"],
            )

    return chunks.mapInArrow(compress, "mp_id long, frame_no long, frame binary, bytes long, crc long, records long")


def merge_frames(plan: DataFrame, frames: DataFrame) -> DataFrame:
    """One row per merged file: (table_id, pack, bin, data, bytes, crc, records, members).

    Parts are copied as they are. Their checksums are taken again while copying, their frame boundaries are walked, and
    the merged file has to have the sum of the parts' lengths and the planned number of records; anything else raises
    CompactionError. A group holds about target_rows records: each part has fewer than half of that.
    """
    packed = bin_pack(plan)
    parts = packed.join(frames.withColumnRenamed("records", "frame_records"), "mp_id", "left")
    part = F.struct("mp_id", "frame_no", "frame", "bytes", "crc", "frame_records", "records")
    groups = parts.groupBy("table_id", "pack", "bin").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    schema = T.StructType(
        [
            T.StructField("table_id", T.LongType()),
            T.StructField("pack", T.IntegerType()),
            T.StructField("bin", T.LongType()),
            T.StructField("data", T.BinaryType()),
            T.StructField("bytes", T.LongType()),
            T.StructField("crc", T.LongType()),
            T.StructField("records", T.LongType()),
            T.StructField("members", T.ArrayType(MEMBER)),
        ]
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                members: dict[int, dict] = {}
                blobs, at = [], 0
                for p in row["parts"]:
                    m = members.setdefault(p["mp_id"], {"mp_id": p["mp_id"], "start": at, "bytes": 0, "records": 0, "planned": p["records"]})
                    if p["frame"] is None:
                        continue
                    if len(p["frame"]) != p["bytes"] or zlib.crc32(p["frame"]) != p["crc"]:
                        raise CompactionError(f"file {p['mp_id']}: frame {p['frame_no']} changed since it was written")
                    blobs.append(p["frame"])
                    at += p["bytes"]
                    m["bytes"] += p["bytes"]
                    m["records"] += p["frame_records"]
                data = b"".join(join_frames(blobs))
                if len(data) != at:
                    raise CompactionError(f"table {row['table_id']}: merged length {len(data)}, expected {at}")
                for m in members.values():
                    if m["records"] != m.pop("planned"):
                        raise CompactionError(f"file {m['mp_id']}: {m['records']} records, another number was planned")
                rows.append({k: row[k] for k in ("table_id", "pack", "bin")} | {"data": data, "bytes": at, "crc": zlib.crc32(data), "records": sum(m["records"] for m in members.values()), "members": list(members.values())})
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return groups.mapInArrow(merge, schema)


def compact(scans: DataFrame, partitions: DataFrame, configs: DataFrame, records: DataFrame) -> DataFrame:
    """Plan, encode and merge; see plan_compaction and merge_frames. The plan is written once, as both others read it."""
    plan = staged(plan_compaction(scans, partitions, configs, records), "plan")
    return merge_frames(plan, encode_frames(records, plan))


def decode_merged(merged: DataFrame, schema: T.StructType) -> DataFrame:
    """The records of merged files, for readers and round-trip tests."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for data in batch.column("data").to_pylist():
                reader = zstandard.ZstdDecompressor()
                text = b"".join(reader.decompress(data[a:b]) for a, b in frame_spans(data))
                yield pa.record_batch([pa.array(text.decode().split("\n")[:-1], pa.string())], names=["line"])

    return merged.select("data").mapInArrow(lines, "line string").select(F.from_json("line", schema, TIMES | {"mode": "FAILFAST"}).alias("r")).select("r.*")


PIECE = 4 << 20  # bytes read at a time


def _read_pieces(path: str) -> Iterator[bytes]:
    where, name = open_uri(path)
    with where.open_input_stream(name, compression=None) as stream:
        while piece := stream.read(PIECE):
            yield piece


def compact_files(spark: SparkSession, source: str, target: str, kind: str = "lines", target_bytes: int = 128 << 20, header: bytes | None = None, suffix: str = "", leave_large: bool = False) -> DataFrame:
    """Concatenate the files of a folder into files of about target_bytes: (path, parts, bytes, crc).

    kind is "lines" (newline-delimited, header optionally kept once per output) or "zstd" (complete frames). Listing
    gives sizes only; each task copies the files of one bin in pieces, so memory does not grow with their sizes, writes
    to a hidden name, reads that back, compares length and checksum with what was joined, and only then renames it; a
    repeated task replaces its own output. With leave_large, files of at least half of target_bytes and bins of one file
    stay where they are and come with their own path and a null crc; else they are copied too, and the target folder
    holds everything. An empty folder yields no rows; empty input files add nothing and are not counted.
    """
    if kind not in ("lines", "zstd"):
        raise ValueError(f"unknown kind {kind!r}")
    folder = qualified(spark, target)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).where(F.col("path").endswith(suffix)).select("path", "length")
    kept = None
    if leave_large:
        kept = listed.where(F.col("length") * 2 >= target_bytes).select("path", F.lit(1).cast("long").alias("parts"), F.col("length").alias("bytes"), F.lit(None).cast("long").alias("crc"))
        listed = listed.where(F.col("length") * 2 < target_bytes)
    total = listed.agg(F.sum("length")).first()[0] or 0
    slices = max(1, int(total // (target_bytes * 64)) + 1)
    salted = listed.withColumn("pack", F.pmod(F.xxhash64("path"), F.lit(slices)).cast("int"))
    before = Window.partitionBy("pack").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    bins = salted.withColumn("bin", F.floor(F.coalesce(F.sum("length").over(before), F.lit(0)) / target_bytes).cast("long"))
    groups = bins.groupBy("pack", "bin").agg(F.sort_array(F.collect_list("path")).alias("paths"), F.sum("length").alias("length"))
    if leave_large:
        kept = kept.unionByName(groups.where(F.size("paths") == 1).select(F.col("paths")[0].alias("path"), F.lit(1).cast("long").alias("parts"), F.col("length").alias("bytes"), F.lit(None).cast("long").alias("crc")))
        groups = groups.where(F.size("paths") > 1)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        where, base = open_uri(folder)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                where.create_dir(base, recursive=True)
                name = f"{base}/part-{row['pack']:05d}-{row['bin']:08d}.{'zst' if kind == 'zstd' else 'txt'}"
                size = crc = 0
                files = map(_read_pieces, row["paths"])
                hidden = f"{base}/_tmp-{uuid.uuid4().hex}"
                with where.open_output_stream(hidden, compression=None) as sink:
                    for piece in join_frame_pieces(files) if kind == "zstd" else join_line_pieces(files, header):
                        sink.write(piece)
                        size += len(piece)
                        crc = zlib.crc32(piece, crc)
                written = again = 0
                with where.open_input_stream(hidden, compression=None) as stream:
                    while piece := stream.read(PIECE):
                        written += len(piece)
                        again = zlib.crc32(piece, again)
                if written != size or again != crc or kind == "zstd" and size != row["length"]:
                    raise CompactionError(f"{name}: {written} bytes written with checksum {again}, {size} with {crc} joined, {row['length']} read")
                where.move(hidden, name)
                rows.append((name, len(row["paths"]), size, crc))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["path", "parts", "bytes", "crc"])

    merged = groups.mapInArrow(copy, "path string, parts long, bytes long, crc long")
    return merged if kept is None else merged.unionByName(kept)
