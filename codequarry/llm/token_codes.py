"""Token-id files of directly addressable codes.

An id is split into chunks of eight bits.  Level 0 holds the lowest chunk of
every id, the next level that of the ids that have more, and so on; a bitmap
per level says which ids continue, and a rank directory (ones before every
512th place) leads from a place in one level to its place in the next.  Any id
of a segment is read with one look-up per level; nothing else is decoded.

A store is a Parquet table of segments (documents in ascending doc_id order,
about SEGMENT_IDS ids each), written and committed by Spark, so it lies in any
file system that Spark writes, and lost tasks are written anew.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.llm.tokens import encoded

SEGMENT_IDS = 1 << 20
MAGIC = b"DAC1"
STEP = 512


def pack(ids):
    """The bytes of a sequence of ids below 2**32."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    levels = []
    while len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(np.append(more, False).astype(np.uint32), np.arange(0, len(more) + 1, STEP))
        levels.append((rest.astype(np.uint8).tobytes(), bits.tobytes(), (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes()))
        rest = rest[more] >> 8
    head, at = struct.pack("<4sQB", MAGIC, len(ids), len(levels)), 0
    for level in levels:
        for x in level:
            head += struct.pack("<QQ", at, len(x))
            at += len(x)
    return head + b"".join(x for level in levels for x in level)


class Packed:
    """Reads what pack() wrote."""

    def __init__(self, raw):
        magic, self.n, depth = struct.unpack_from("<4sQB", raw)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        body = 13 + depth * 48
        self.levels = []
        for k in range(depth):
            spans = struct.unpack_from("<6Q", raw, 13 + 48 * k)
            chunk, bits, ranks = (np.frombuffer(raw, dtype=t, count=size // w, offset=body + at) for t, w, at, size in zip((np.uint8, np.uint8, "<u4"), (1, 1, 4), spans[::2], spans[1::2], strict=True))
            self.levels.append((chunk, bits, ranks))

    def __len__(self):
        return self.n

    def __getitem__(self, i):
        """One id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for chunk, bits, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // STEP * STEP
            some = bits[first >> 3 : (i >> 3) + 1].copy()
            some[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[i // STEP]) + int(np.bitwise_count(some).sum())
            shift += 8
        return value

    def all(self):
        """All ids."""
        values = np.zeros(0, dtype=np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            more = np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)
            own = chunk.astype(np.uint32)
            own[more] |= values << np.uint32(8)
            values = own
        return values


def crcs(ids, sizes):
    """crc32 of each run of ids as little-endian unsigned 32-bit integers."""
    raw, ends = np.ascontiguousarray(ids, dtype="<u4").tobytes(), np.cumsum(sizes) * 4
    return [zlib.crc32(raw[b - 4 * n : b]) for b, n in zip(ends.tolist(), np.asarray(sizes).tolist(), strict=True)]


def with_end(ids, sizes, end_id):
    """Each document's ids with the end id after them."""
    ends = np.cumsum(sizes)
    return np.insert(ids, ends, end_id), sizes + 1


def write(docs, path, tokenizer, end_id):
    """Writes the ids of docs (doc_id, text) to a store at `path`.

    Documents come in ascending doc_id order, null first, equal ids by text.
    Null text counts as empty; each document ends with `end_id`.  Repeated rows
    are documents of their own, other columns are ignored, an empty table makes
    a store without segments.
    """

    def segments(batches):
        part = TaskContext.get().partitionId()
        number = before = 0
        ids, sizes, names = [], [], []

        def flush():
            nonlocal number, before, ids, sizes, names
            run, n = np.concatenate(ids), np.concatenate(sizes)
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(run)], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([pack(run)], pa.binary()), *(pa.array([f((x for x in names if x is not None), default=None)], pa.int64()) for f in (min, max))], ["part", "segment", "before", "n_ids", "doc_ids", "sizes", "codes", "least_id", "last_id"])
            number, before, ids, sizes, names = number + 1, before + len(run), [], [], []
            return row

        for batch in batches:
            for lo, some, counts in encoded(batch.column(1), tokenizer):
                some, counts = with_end(some, counts, end_id)
                ids.append(some.astype(np.uint32))
                sizes.append(counts)
                names += batch.column(0).slice(lo, len(counts)).to_pylist()
                if sum(map(len, ids)) >= SEGMENT_IDS:
                    yield flush()
        if ids:
            yield flush()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(segments, "part int, segment int, before long, n_ids long, doc_ids array<long>, sizes array<long>, codes binary, least_id long, last_id long").write.parquet(path)


def read(spark, path):
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a store; no rows of one without segments."""
    store = spark.read.parquet(path)
    # one row for each partition that was written
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], dtype=np.int64)
                start = row["base"] + row["before"] + np.cumsum(sizes) - sizes
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(sizes), pa.array(crcs(Packed(row["codes"]).all(), sizes), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = store.join(F.broadcast(base), "part").select("base", "before", "doc_ids", "sizes", "codes")
    return rows.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token(spark, path, doc_id, i):
    """The id at place `i` of a document, or None; statistics lead to its segment, where one id is decoded.

    Of several documents of one doc_id it is one's; null names none.
    """
    row = spark.read.parquet(path).filter(F.lit(doc_id).cast("long").between(F.col("least_id"), F.col("last_id"))).filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).select("doc_ids", "sizes", "codes").first()
    if row is None:
        return None
    k = row["doc_ids"].index(doc_id)
    return Packed(bytes(row["codes"]))[sum(row["sizes"][:k]) + i] if 0 <= i < row["sizes"][k] else None
