"""References to records that do not exist, are deleted or come later."""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.operators.common import current_rows, join_unique, scratch_path, staged
from sedimenta.sources.store import open_uri

FALSE_POSITIVES = 0.01
BLOCK_KEYS = 1 << 20  # keys of one block of the filter, about 1.2 MB
MOST_BLOOM_BYTES = 64 << 20  # of a filter that is broadcast; of a larger one each task loads the blocks that it needs
HELD_BLOCKS = 32  # blocks of a larger filter that a task keeps
SALTS = 16  # tasks over which the references to one block are spread


class BloomFilter:
    """A Bloom filter in blocks of 64-bit words; a key's bits are at h1 + i * h2 modulo the bits of its block."""

    def __init__(self, blocks: int, bits: int, hashes: int, paths: dict[int, str]):
        self.blocks, self.bits, self.hashes, self.paths = blocks, bits, hashes, paths
        self.held: OrderedDict[int, np.ndarray] = OrderedDict()

    @staticmethod
    def size_for(keys: int, rate: float = FALSE_POSITIVES) -> tuple[int, int]:
        """(bits, hashes) for a number of keys."""
        bits = max(64, math.ceil(-keys * math.log(rate) / math.log(2) ** 2 / 64) * 64)
        return bits, max(1, round(bits / max(keys, 1) * math.log(2)))

    @property
    def bytes(self) -> int:
        return self.blocks * self.bits // 8

    def places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(self.hashes):
            yield np.mod(h1 + np.int64(i) * h2, np.int64(self.bits))

    def words(self, block: int) -> np.ndarray | None:
        """The words of a block, None for a block without keys."""
        if block in self.held:
            self.held.move_to_end(block)
        elif block in self.paths:
            where, name = open_uri(self.paths[block])
            with where.open_input_stream(name, compression=None) as stream:
                self.held[block] = np.frombuffer(stream.read(), np.uint64)
            if self.bytes > MOST_BLOOM_BYTES and len(self.held) > HELD_BLOCKS:
                self.held.popitem(last=False)
        return self.held.get(block)

    def contains(self, block: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h1), bool)
        for b in np.unique(block).tolist():
            words = self.words(b)
            if words is None:
                continue
            some = np.flatnonzero(block == b)
            there = np.ones(len(some), bool)
            for at in self.places(h1[some], h2[some]):
                there &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            found[some] = there
        return found


def hash_columns(key: str, blocks: int) -> list[Column]:
    """A key's block and two 31-bit-safe hashes: sums of h1 + i * h2 stay within 64 bits."""
    h1, h2 = F.shiftrightunsigned(F.xxhash64(key), 4), F.shiftrightunsigned(F.xxhash64(F.lit(7), key), 16)
    return [F.pmod(F.xxhash64(F.lit(11), key), F.lit(blocks)).cast("int").alias("block"), h1.alias("h1"), h2.alias("h2")]


def build_bloom(keys: DataFrame, key: str) -> BloomFilter:
    """Filter of the non-null keys: each key goes to its block's task once, which sets bits and writes the block.

    Blocks have about BLOCK_KEYS keys, whatever their number. Repeated keys make the filter larger, not wrong.
    """
    there = keys.where(F.col(key).isNotNull())
    count = there.count()
    blocks = max(1, -(-count // BLOCK_KEYS))
    bloom = BloomFilter(blocks, *BloomFilter.size_for(-(-count // blocks) + 4 * math.isqrt(-(-count // blocks))), {})
    folder = scratch_path(keys.sparkSession, "bloom")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            block, h1, h2 = (c.to_numpy() for c in batch.columns)
            for b in np.unique(block).tolist():
                words = made.setdefault(b, np.zeros(bloom.bits // 64, np.uint64))
                for at in bloom.places(h1[block == b], h2[block == b]):
                    np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        paths = []
        for b, words in made.items():
            where, name = open_uri(f"{folder}/{b:08d}-{uuid.uuid4().hex}")
            where.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with where.open_output_stream(name, compression=None) as out:
                out.write(words.tobytes())
            paths.append(f"{folder}/{name.rsplit('/', 1)[1]}")
        yield pa.record_batch([pa.array(list(made), pa.int32()), pa.array(paths, pa.string())], names=["block", "path"])

    # One small row per block reaches the driver.
    bloom.paths = {r[0]: r[1] for r in there.select(*hash_columns(key, blocks)).repartition(blocks, "block").mapInArrow(run, "block int, path string").collect()}
    return bloom


def split_by_bloom(refs: DataFrame, key: str, bloom: BloomFilter) -> DataFrame:
    """Adds `_maybe`: False proves that the key is not among the filter's keys.

    A filter of up to MOST_BLOOM_BYTES is broadcast. References to a larger one are brought together by block first, a
    block's spread over SALTS tasks, so that a key with very many references does not end in one; tasks load the blocks
    that they meet.
    """
    plain = hash_columns(key, bloom.blocks)
    if bloom.bytes <= MOST_BLOOM_BYTES:
        for b in bloom.paths:
            bloom.words(b)
    else:
        salt = F.pmod(F.xxhash64(F.lit(13), *[F.col(f"`{c}`").cast("string") for c in refs.columns]), F.lit(SALTS))
        refs = refs.withColumn("__block", plain[0]).withColumn("__salt", salt).repartition("__block", "__salt").drop("__block", "__salt")
    shared = refs.sparkSession.sparkContext.broadcast((bloom.blocks, bloom.bits, bloom.hashes, bloom.paths, dict(bloom.held)))
    held: dict = {}

    def probe(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        if not held:
            blocks, bits, hashes, paths, words = shared.value
            held["bloom"] = BloomFilter(blocks, bits, hashes, paths)
            held["bloom"].held.update(words)
        for block, h1, h2 in batches:
            yield pd.Series(held["bloom"].contains(block.to_numpy(np.int64), h1.to_numpy(np.int64), h2.to_numpy(np.int64)))

    return refs.withColumn("_maybe", F.pandas_udf(probe, T.BooleanType())(*plain))


def find_orphans(refs: DataFrame, parents: DataFrame, key: str, at: str) -> DataFrame:
    """refs with `orphan_kind`: missing, deleted or late; other references are left out.

    parents has one row per key with `deleted_at` and `created_at`. A reference whose key the Bloom filter denies is
    missing; only the others are joined exactly. Null keys refer to nothing and are ignored; a null time of a
    reference or a parent proves neither deletion nor lateness.
    """
    there = staged(parents.select(key, F.col("deleted_at").alias("_deleted"), F.col("created_at").alias("_created"), F.lit(True).alias("_there")), "parents")
    asked = staged(split_by_bloom(refs.where(F.col(key).isNotNull()), key, build_bloom(there, key)), "references")
    lost = asked.where(~F.col("_maybe")).drop("_maybe").withColumn("orphan_kind", F.lit("missing"))
    met = join_unique(asked.where("_maybe").drop("_maybe"), there, key)
    kind = F.when(F.col("_there").isNull(), "missing").when(F.col("_deleted") <= F.col(at), "deleted").when(F.col("_created") > F.col(at), "late")
    exact = met.withColumn("orphan_kind", kind).where("orphan_kind is not null").select(*refs.columns, "orphan_kind")
    return exact.unionByName(lost.select(*exact.columns))


def file_references(manifests: DataFrame, restores: DataFrame) -> DataFrame:
    """Distinct (ref_table, ref_id, mp_id, at) of current manifests of any kind and of restores."""
    newest = F.max(F.struct("loaded_at", "created_at", F.col("tables.mp_ids").alias("lists"))).alias("r")
    current = manifests.where("backup_id is not null").groupBy("backup_id").agg(newest)
    backed = current.select(F.lit("backup_manifests").alias("ref_table"), F.col("backup_id").alias("ref_id"), F.col("r.created_at").alias("at"), F.explode("r.lists").alias("ids")).select("ref_table", "ref_id", F.explode("ids").alias("mp_id"), "at")
    restored = restores.where("restore_id is not null").select(F.lit("restore_results").alias("ref_table"), F.col("restore_id").alias("ref_id"), F.explode("mps_missing").alias("mp_id"), F.col("restored_at").alias("at"))
    return backed.unionByName(restored).where("mp_id is not null").groupBy("ref_table", "ref_id", "mp_id").agg(F.max("at").alias("at"))


def file_orphans(manifests: DataFrame, restores: DataFrame, partitions: DataFrame) -> DataFrame:
    """(ref_table, ref_id, mp_id, at, orphan_kind) of references to files that are not there at that time."""
    parents = current_rows(partitions, "mp_id", ["mp_id", "loaded_at", "purged_at", "commit_ts"]).select("mp_id", F.col("purged_at").alias("deleted_at"), F.col("commit_ts").alias("created_at"))
    return find_orphans(file_references(manifests, restores), parents, "mp_id", "at")


def orphan_report(orphans: DataFrame, period: str = "month") -> DataFrame:
    """(ref_table, period, orphan_kind, refs, ids): counts per referring table and period; null times form their own period."""
    return orphans.groupBy("ref_table", F.date_trunc(period, "at").cast("timestamp_ntz").alias("period"), "orphan_kind").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("mp_id").alias("ids"))
