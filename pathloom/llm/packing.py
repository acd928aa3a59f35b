"""Best-fit packing of token sequences, improved by swap-based local search.

Documents are encoded and cut into pieces of at most the capacity. Pieces are dealt
evenly to groups of bounded size; each group is packed by best fit in descending
length and then improved: documents are moved, exchanged one for one or two for one
between underfull bins whenever that increases the sum of squared fills, until no
exchange is left or no bin fewer is possible. Bins with more than a hundredth of room
are taken apart and packed again in fewer, later groups, as long as that leaves fewer
such pieces, so that in all only few bins stay underfull.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .tokens import BLOCK_BYTES, default_path, encoder

CAPACITY = 4096
#: Pieces of a group, and the part of the capacity from which a bin's room makes it worth packing again.
GROUP, UNDERFULL = 8_000, 0.01

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_into_pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A null text is an empty one."""
    path = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches, most=BLOCK_BYTES):
            ids, at = encode(batch.column("text"))
            sizes = np.diff(at)
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            body, low = memoryview(ids.tobytes()), 4 * (at[row] + start)
            crcs = [zlib.crc32(body[a:b]) for a, b in zip(low.tolist(), (low + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes by bin: each length, longest first, goes to the fullest bin with room for it."""
    bins: list[list[int]] = []
    by_gap: dict[int, list[int]] = {}
    gaps = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        above = gaps >> size
        if above:
            gap = size + (above & -above).bit_length() - 1
            k = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
        else:
            gap, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        if gap > size:
            by_gap.setdefault(gap - size, []).append(k)
            gaps |= 1 << (gap - size)
    return bins


def _best_exchange(low: np.ndarray, high: np.ndarray, room: np.ndarray, lead: np.ndarray) -> tuple[int, int, int, int] | None:
    """The exchange that moves the most length from a bin to fuller ones: places (i, j, k) and its gain.

    low: lengths in the bin, ascending. high: lengths that may come back, 0 for a plain move; room and
    lead: of each one's bin, its room and by how much it is fuller. i (and j, if not -1) go to the
    bin of k. A net transfer d > 0 to a fuller bin raises the sum of squares by 2 d (lead + d), and
    none is larger than the room. Pairs i, j with the largest sum that fits are found by search.
    """
    fits = np.where(lead >= 0, room + high, -1)
    at = np.searchsorted(low, fits, side="right") - 1
    gain = np.where(at >= 0, low[np.maximum(at, 0)] - high, 0)
    best = int(gain.argmax())
    found = (int(at[best]), -1, best, int(gain[best]))
    for i in range(len(low) - 1):
        if found[3] >= int(room[lead >= 0].max(initial=0)):
            break
        rest = np.searchsorted(low[i + 1 :], fits - low[i], side="right") + i
        gain = np.where((rest > i) & (fits >= 0), low[i] + low[np.maximum(rest, 0)] - high, 0)
        best = int(gain.argmax())
        if gain[best] > found[3]:
            found = (i, int(rest[best]), best, int(gain[best]))
    return found if found[3] > 0 else None


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empties the least full bins into the others while that increases the sum of squared fills.

    Ends when no exchange is left, when as few bins are left as the lengths need, or when the room
    of all other bins is too small to empty the least full one. Each exchange raises the sum, so it ends.
    """
    size = np.array(lengths, np.int64)
    bins = [list(b) for b in bins if b]
    fill = np.array([size[b].sum() for b in bins], np.int64)
    least = -(-int(size.sum()) // capacity) if lengths else 0
    left, low = len(bins), -1
    while left > least:
        ahead = np.flatnonzero((fill > 0) & (fill < capacity) & ((fill > fill[low]) | ((fill == fill[low]) & (np.arange(len(bins)) > low)))) if low >= 0 else np.flatnonzero((fill > 0) & (fill < capacity))
        if not len(ahead):
            return [b for b in bins if b]
        low = int(ahead[fill[ahead].argmin()])
        others = np.flatnonzero((fill > 0) & (fill < capacity) & (np.arange(len(bins)) != low))
        if int((capacity - fill[others]).sum()) < int(fill[low]):
            return [b for b in bins if b]
        changed = False
        while bins[low]:
            others = others[fill[others] < capacity]
            own = np.array(sorted(bins[low], key=lambda i: lengths[i]))
            back = [*[-1] * len(others), *[i for k in others for i in bins[k]]]
            where = np.concatenate([others, np.repeat(others, [len(bins[k]) for k in others])]).astype(np.int64)
            high = np.where(np.array(back, np.int64) >= 0, size[back], 0)
            found = _best_exchange(size[own], high, capacity - fill[where], fill[where] - fill[low])
            if found is None:
                break
            i, j, k, gain = found
            to, given = int(where[k]), {int(own[i])} | ({int(own[j])} if j >= 0 else set())
            returned = [back[k]] if back[k] >= 0 else []
            bins[low] = [x for x in bins[low] if x not in given] + returned
            bins[to] = [x for x in bins[to] if x not in returned] + sorted(given)
            fill[low], fill[to], changed = fill[low] - gain, fill[to] + gain, True
        if not bins[low]:
            left -= 1
        if changed:
            low = -1  # what has changed may let an emptier bin go on
    return [b for b in bins if b]


def pack_group(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _packer(capacity: int, level: int, last: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lengths, group = rows.column("length").to_pylist(), key[0].as_py()
        bins = pack_group(lengths, capacity)
        fill = [sum(lengths[i] for i in b) for b in bins]
        again = set() if last else {k for k in range(len(bins)) if capacity - fill[k] > UNDERFULL * capacity}
        n = len(lengths)
        ids, offsets, done = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                ids[i] = (level << 56) | (group << 24) | k
                offsets[i], done[i] = at, k not in again
                at += lengths[i]
        rows = rows.drop_columns(["_group"])
        for name, column in (("sequence_id", ids), ("offset", offsets), ("_done", done)):
            rows = rows.append_column(name, pa.array(column))
        return rows

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All rows of ``pieces`` (column ``length``, 1 to ``capacity``) with sequence_id and offset.

    Other columns come along as they are, but for ``_group``, ``_done``, ``sequence_id`` and ``offset``,
    which it makes itself and refuses in the input. Equal rows are packed as separate pieces. Groups are
    dealt by row number of a materialised table, so no key makes one large.
    """
    if clash := {"_group", "_done", "sequence_id", "offset"} & set(pieces.columns):
        raise ValueError(f"pieces have columns that packing makes: {sorted(clash)}")
    rest, done, level = cut(pieces), [], 0
    count = rest.count()
    schema = rest.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    schema += ", sequence_id long, offset long, _done boolean"
    last = count <= GROUP
    while True:
        groups = max(1, -(-count // GROUP))
        dealt = rest.withColumn("_group", F.pmod(F.monotonically_increasing_id() % (1 << 33) + F.spark_partition_id() * 7919, F.lit(groups)))
        packed = dealt.groupBy("_group").applyInArrow(_packer(capacity, level, last), schema)
        if last:
            return reduce(DataFrame.unionByName, [*done, packed.drop("_done")])
        packed = cut(packed)
        done.append(packed.where("_done").drop("_done"))
        rest = packed.where("not _done").drop("_done", "sequence_id", "offset")
        before, count, level = count, rest.count(), level + 1
        # packing again ends where one group holds the rest, or where most of it only comes back
        last = count <= GROUP or count > 0.9 * before


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The pieces of all documents with their sequences.

    Null and empty texts make a piece of the end id alone; very long ones are cut into as many
    pieces as they need; of pieces with one length the first is packed first; null ids and repeated
    rows are kept; an empty table gives an empty result; other columns, whatever their names, are
    ignored.
    """
    return pack(cut_into_pieces(documents, capacity, vocabulary), capacity)
