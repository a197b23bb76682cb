"""Pack documents into fixed-length sequences by the sum-of-squares rule.

Documents are tokenised once and written; only longer ones are cut.  Full
pieces are sequences of their own.  The others, one item a document, are dealt
by a hash into groups of bounded size that grow in number with the input; in
each group an item goes to the open sequence (or a new one) for which the sum
of the squared counts of open sequences per residual gap becomes smallest.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import materialize

_LOADED: dict[tuple, object] = {}
#: A single space between two non-blanks always begins a new pre-token, so a text may be cut before it.
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_LONG = 50_000


class Encoder:
    """Token ids of the byte-level BPE in ``json_path``.

    ``ranks_path`` holds the same vocabulary as ranks, which a faster library
    reads; the ids are equal.  A text with a string of a special token, or with
    a stretch of ``_LONG`` characters that has no safe cut, goes to the first."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer
        self.exact = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        if len(text) <= _LONG:
            return self.fast.encode_ordinary(text)
        out, at = [], 0
        while at < len(text):
            cut = _SAFE_CUT.search(text, at + _LONG)
            end = cut.start() if cut else len(text)
            part = text[at:end]
            out += self.fast.encode_ordinary(part) if end - at <= 2 * _LONG else self.exact.encode(part, add_special_tokens=False).ids
            at = end
        return out


def _encoder(*paths: str) -> Encoder:
    if paths not in _LOADED:
        _LOADED[paths] = Encoder(*paths)
    return _LOADED[paths]


_PIECES = "doc_id {id}, piece int, start long, length long, ids binary, ids_crc32 long"
_COLUMNS = ["doc_id", "piece", "start", "length", "ids", "ids_crc32"]


def _pieces(paths: tuple[str, str, str], capacity: int, end_id: int):
    def flush(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        source, *rest = zip(*rows)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        arrays = [batch.column(0).take(pa.array(source)), *[pa.array(x, k) for x, k in zip(rest, kinds)]]
        return pa.RecordBatch.from_arrays(arrays, names=_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(*paths)
        for batch in batches:
            rows, held = [], 0
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                first = len(ids) % capacity or capacity
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = stop - capacity if piece else 0
                    part = ids[start:stop].tobytes()
                    rows.append((i, piece, start, stop - start, part, zlib.crc32(part)))
                held += len(ids)
                if held > 2_000_000:   # a few megabytes at a time, however long the texts
                    yield flush(batch, rows)
                    rows, held = [], 0
            if rows:
                yield flush(batch, rows)
    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``(bin, offset, bins)`` of items shorter than ``capacity``, in the given order.

    Moving an item of length s into a bin with gap g changes the sum of squares
    by 1 - 2 N(g) and 1 + 2 N(g - s) (nothing for a closed bin).  Ties go to the
    smallest gap; a new bin is opened only if none fits, which with items from
    long to short wastes least.  The state is one stack of bins a gap."""
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    leave = np.full(capacity + 1, 2 ** 60)   # 1 - 2 N(g), out of reach without such a bin
    leave[capacity] = 2 ** 59                # a new bin is always there, but comes after any that fits
    enter = np.ones(capacity + 1, np.int64)  # 1 + 2 N(g)
    enter[0] = 0
    where, offset, bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        gap = s + int(np.argmin(leave[s:] + enter[:capacity + 1 - s]))
        if gap == capacity:
            place, bins = bins, bins + 1
        else:
            place = open_bins[gap].pop()
            count[gap] -= 1
            leave[gap] = 1 - 2 * count[gap] if count[gap] else 2 ** 60
            enter[gap] = 1 + 2 * count[gap]
        where[i], offset[i] = place, capacity - gap
        left = gap - s
        if left:
            open_bins[left].append(place)
            count[left] += 1
            leave[left], enter[left] = 1 - 2 * count[left], 1 + 2 * count[left]
    return where, offset, bins


def _place(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        short = group[group.length < capacity]
        where, offset, bins = sum_of_squares(short.length.to_numpy(), capacity)
        base = int(group.grp.iloc[0]) << 32   # a group has far fewer sequences
        seq, off = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        packed = (group.length < capacity).to_numpy()
        seq[packed], off[packed] = base + where, offset
        full = group.full.to_numpy()
        return pd.DataFrame({"uid": group.uid, "packed_in": seq, "offset": off,
                             "full_from": base + bins + np.cumsum(full) - full})
    return run


def pack(df: DataFrame, json_path: str, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 2,
         doc_id: str = "doc_id", text: str = "text", group_items: int = 16384) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit token ids; a document's ids end
    with ``end_id``.  Documents longer than ``capacity`` are cut into full pieces,
    of which the first may be shorter.  Null text is an empty text (one piece,
    the end id); null and repeated ids are ordinary documents; empty table: no
    rows; other columns are ignored, whatever their names."""
    spark = df.sparkSession
    light = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = light.schema["doc_id"].dataType.simpleString()
    path = scratch_dir(spark, "pieces")
    (light.mapInArrow(_pieces((json_path, ranks_path, pattern), capacity, end_id), _PIECES.format(id=id_type))
     .withColumn("uid", F.monotonically_increasing_id() - F.col("piece"))   # the number of a document's first piece
     .write.option("compression", "zstd").parquet(path))
    pieces = spark.read.parquet(path)
    # piece 0 is the only one that may be short; the others are full
    items = pieces.groupBy("uid").agg(F.min("length").alias("length"),
                                      F.sum(F.when(F.col("length") == capacity, 1).otherwise(0)).alias("full"))
    items = materialize(items, "items")
    groups = -(-max(1, items.count()) // group_items)
    dealt = items.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int"))
    placed = dealt.groupBy("grp").applyInPandas(_place(capacity), "uid long, packed_in long, offset long, full_from long")
    short = F.col("length") < capacity
    first_full = F.when(F.col("first_short"), 1).otherwise(0)
    placed = placed.join(items.select("uid", (F.col("length") < capacity).alias("first_short")), "uid")
    return pieces.join(placed, "uid").select(
        "doc_id", "piece", "start", "length", "ids", "ids_crc32",
        F.when(short, F.col("packed_in")).otherwise(F.col("full_from") + F.col("piece") - first_full).alias("sequence_id"),
        F.when(short, F.col("offset")).otherwise(F.lit(0)).cast("long").alias("offset"))
