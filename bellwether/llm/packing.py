"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

One sequence is filled greedily with the longest unpacked document that fits. When none fits and a gap is
left, its smallest document is taken out if two unpacked documents fit the expanded gap more tightly; that is
repeated while the gap shrinks.

Documents of one length are interchangeable, so the packing is decided on the histogram of lengths: at most
``capacity`` numbers, whatever the corpus. A way to fill a sequence is used as often as the histogram allows, which
takes some length under the number that this way uses; so there are at most about ``capacity * ln(capacity)`` ways, and
they, too, are bounded by the capacity alone. The driver sees only these.

Documents are encoded once. Each task numbers its pieces within each length as it writes them; the counts of (task, length) become
offsets by running sums, so every piece has an exact number among all of its length without a
sort, and finds its sequence and place by a search in the ways.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bellwether.llm.common import stored
from bellwether.llm.tokens import encoder, vocabulary


def pieces(docs: DataFrame, blob: bytes, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth) and ``ids`` if asked for.

    A document is its ids and ``end_id``. Longer ones are cut so that all pieces but the first are full.
    ``nth`` numbers the pieces of one length within the task ``part``.
    """
    fields = [T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "part", "nth"))]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(blob)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(shared.value), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            at, found, kept = [], [], []
            for i, t in enumerate(batch.column(1)):
                ids = np.array([*encode(t.as_py()), end_id], dtype="<u4")
                first = len(ids) % capacity or capacity
                for k, (s, e) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity), strict=True)):
                    at.append(i)
                    found.append((k, s, e - s, zlib.crc32(ids[s:e].tobytes()), part, seen[e - s]))
                    seen[e - s] += 1
                    if keep_ids:
                        kept.append(ids[s:e])
            numbers = np.array(found, dtype=np.int64).reshape(-1, 6)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers[:, 0], pa.int32()), *(pa.array(numbers[:, c]) for c in range(1, 6))]
            columns += [pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f.name for f in fields)])

    return rows.mapInArrow(cut, T.StructType([rows.schema["doc_id"], *fields]))


def _tightest_pair(free: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the greatest sum over ``least`` and up to ``room`` (ties: the longest first one)."""
    lengths = np.arange(room + 1)
    upto = np.maximum.accumulate(np.where(free[: room + 1] > 0, lengths, 0))
    one = np.flatnonzero(free[:room])
    other = np.minimum(upto[room - one], upto[one])  # one is the longer
    alone = (other == one) & (free[one] < 2)
    other[alone] = upto[one[alone] - 1]
    one, other = one[other > 0], other[other > 0]
    if not len(one) or (one + other).max() <= least:
        return None
    best = len(one) - 1 - int(np.argmax((one + other)[::-1]))
    return int(one[best]), int(other[best])


def _fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """How many documents of each length the next sequence takes."""
    free, taken, gap = counts.copy(), {}, capacity

    def move(length: int, n: int) -> None:
        nonlocal gap
        free[length] -= n
        taken[length] = taken.get(length, 0) + n
        gap -= n * length
        if not taken[length]:
            del taken[length]

    while gap:
        fits = np.flatnonzero(free[: gap + 1])
        if not len(fits):
            break
        move(int(fits[-1]), int(min(free[fits[-1]], gap // fits[-1])))
    while gap and sum(taken.values()) > 1:
        smallest = min(taken)
        pair = _tightest_pair(free, gap + smallest, smallest)
        if pair is None:
            break
        move(smallest, -1)
        for length in pair:
            move(length, 1)
    return taken


def ways(counts: dict[int, int], capacity: int = 2048) -> list[tuple[dict[int, int], int]]:
    """(documents of each length, number of sequences filled so) until every counted document has its place."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    found = []
    while left.any():
        taken = _fill(left, capacity)
        times = int(min(left[length] // n for length, n in taken.items()))
        for length, n in taken.items():
            left[length] -= n * times
        found.append((taken, times))
    return found


def _places(found: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first number, documents in a sequence, first sequence, offset), by length and number."""
    rows, used, sequence = [], {}, 0
    for taken, times in found:
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, blob: bytes | None = None, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Null and empty texts are the end id alone; repeated rows and ids keep their rows, a null id stays null; which of
    two equally long pieces goes where is free and follows the order in which the tasks read them; an empty table
    gives an empty table; other columns are ignored whatever their names.
    """
    cut = stored(pieces(docs, vocabulary() if blob is None else blob, capacity, end_id, keep_ids, doc_id, text), "pieces")
    counts = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = _places(ways(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "piece-offsets")
    keys = (places[:, 0] << 48) + places[:, 1]

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        size, n = length.to_numpy(), number.to_numpy()
        _, first, each, sequence, offset = places[np.searchsorted(keys, (size << 48) + n, side="right") - 1].T
        return pd.DataFrame({"sequence_id": sequence + (n - first) // each, "offset": offset + (n - first) % each * size})

    numbered = cut.join(starts, ["part", "length"]).withColumn("at", placed("length", F.col("first") + F.col("nth")))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of packed pieces with ids; a group holds at most ``capacity`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def fewest(total_tokens: int, capacity: int = 2048) -> int:
    """No packing needs fewer sequences."""
    return math.ceil(total_tokens / capacity)
