"""Sequence packing along a space-filling curve.

A document's hashed vector (byte pairs hashed into 1,024 counts) is projected by a
fixed Gaussian matrix to three dimensions and given its Hilbert key.  Documents are
range-sorted by that key, so neighbours on the curve have like texts, and packed
in that order: ids flow into sequences of 1,024, a document that does not fit is
cut.  What is left at a partition's end is cut into sequences of a power of two,
which need no padding, so there is no padding at all.

Text is shuffled once and each text is encoded once, in the task that packs it.
The sort key ends in a hash of id and text and in a row number, so a group of equal
texts or equal rows spreads over as many partitions as it needs.  Partitions are as
many as PARTITION_BYTES of text ask for, so a task's input does not grow with the table.

Ids are those of the vocabulary with special strings read as ordinary text: a document
that names the end-of-text string cannot end its sequence.

Defined results: null text is empty and packs as its end id alone; a null doc_id
is kept as null; repeated rows are packed once each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from careerloom.llm import tokens
from careerloom.llm.hilbert import hilbert_key
from careerloom.llm.shared import bound_batches

LENGTH = 1024
END_ID = 0
DIMS, BITS = 3, 10
_COUNTS = 1024
#: Bytes of text in a partition, about.
PARTITION_BYTES = 32 << 20
#: Bytes of text turned into vectors at a time.
_CHUNK = 4_000_000
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _projection() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).normal(size=(_COUNTS, DIMS))


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """Hilbert keys of texts given as UTF-8."""
    sizes = np.array([len(t) for t in texts], np.int64)
    body = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    following = body[1:].copy()
    following[np.cumsum(sizes)[sizes > 0] - 1] = 0  # a text's last byte pairs with 0, whatever text comes next
    pairs = ((body[:-1].astype(np.uint32) * np.uint32(0x9E3B) + following * np.uint32(0x85EB)) >> np.uint32(3)) & np.uint32(_COUNTS - 1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    counts = np.bincount(owner * _COUNTS + pairs, minlength=len(texts) * _COUNTS).reshape(len(texts), _COUNTS)
    share = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    place = np.tanh(share @ _projection())
    grid = np.clip(((place + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_key(grid, BITS)


@pandas_udf(T.LongType())
def _keys(texts: pd.Series) -> pd.Series:
    raw = [t.encode() for t in texts]
    out, at = [], 0
    while at < len(raw):
        stop, n = at, 0
        while stop < len(raw) and (stop == at or (n + len(raw[stop]) <= _CHUNK and stop - at < 256)):
            n += len(raw[stop])
            stop += 1
        out.append(curve_keys(raw[at:stop]))
        at = stop
    return pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64))


class Packer:
    """Cuts a stream of documents' ids into sequences; one for each partition."""

    def __init__(self, first_sequence: int, length: int = LENGTH):
        self.sequence, self.length, self.fill = first_sequence, length, 0
        self.open: list[tuple] = []

    def _row(self, piece: tuple, offset: int) -> tuple:
        doc, start, ids, total = piece
        return doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for piece in pieces:
            yield self._row(piece, offset)
            offset += len(piece[2])
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            take = min(self.length - self.fill, len(ids) - at)
            self.open.append((doc, at, ids[at : at + take], len(ids)))
            self.fill += take
            at += take
            if self.fill == self.length:
                yield from self._emit(self.open)
                self.open, self.fill = [], 0

    def close(self) -> Iterator[tuple]:
        """The open sequence as sequences of powers of two."""
        left = self.open
        while self.fill:
            size = 1 << (self.fill.bit_length() - 1)
            part, n = [], 0
            while n < size:
                doc, start, ids, total = left.pop(0)
                take = min(size - n, len(ids))
                part.append((doc, start, ids[:take], total))
                if take < len(ids):
                    left.insert(0, (doc, start + take, ids[take:], total))
                n += take
            yield from self._emit(part)
            self.fill -= size


def pack(df: DataFrame, *, doc: str = "doc_id", text: str = "text", json_path: str, rank_path: str, pattern: str, length: int = LENGTH) -> DataFrame:
    """A row per piece, see SCHEMA; sequence ids are unique, offsets gapless in each sequence."""
    bound_batches(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    size = df.agg(F.sum(F.octet_length(body))).first()[0] or 0
    keyed = df.select(F.col(doc).cast("long").alias("doc_id"), body.alias("text")).withColumn("_key", _keys("text")).withColumn("_tie", F.xxhash64("doc_id", "text")).withColumn("_row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(1 + size // PARTITION_BYTES, "_key", "_tie", "_row").sortWithinPartitions("_key", "_tie", "doc_id").select("doc_id", "text")
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() << 36, length)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                ids = tokens.encode(value.as_py(), json_path, rank_path, pattern)
                rows.extend(packer.add(key.as_py(), np.append(ids, np.uint32(END_ID))))
                if len(rows) >= 10_000:
                    yield flush()
        rows.extend(packer.close())
        if rows:
            yield flush()

    return ordered.mapInArrow(run, SCHEMA)
