"""Cross-entropy difference by matched bigram models of a target and a background corpus.

Both models have one vocabulary (words, hashed to VOCABULARY ids), one order and one smoothing: a
word's probability after the word before it is smoothed towards that of the word alone, and this
towards the uniform one. The target corpus and all other documents, the background, share no
document, and a document's own counts are left out of the model that it belongs to, so it is never
scored by itself. Its score is its mean loss per word under the target model less that under the
background model: the lower, the more it is like the target.

Counts cover every word of every text and stay distributed. Documents are dealt to blocks of
bounded size; a block counts its own n-grams and sends them, sorted and packed, to the parts of
the hash range. A part adds them up and returns to each block the totals of the n-grams that other
blocks have too. Blocks and parts grow in number with the corpus, not in size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coder import read_varints, varints
from .common import mix, slices, utf8, word_spans, words

#: Ids that words are hashed to.
VOCABULARY = 1 << 24
#: Pseudo-counts given to the next lower order.
PRIOR = 2.0
#: Text bytes of a block, and words whose n-grams make a part of the hash range.
BLOCK, PART = 1 << 22, 1 << 21
#: A hash has so many bits more than the number of words has, so that one n-gram in a million meets another.
SPARE_BITS = 21

_START = np.uint64(VOCABULARY)


def ngrams(hashes: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``bits`` bits of word and bigram at each word of all rows, and each word's row.

    Before a text stands a start sign, which is a word before, but never a word.
    """
    ids = hashes >> np.uint64(40)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    before = np.full(len(ids), _START)
    before[1:] = ids[:-1]
    before[first[:-1][np.diff(first) > 0]] = _START
    cut = np.uint64(64 - bits)
    one = lambda x: mix(x + np.uint64(0xA24BAED4963EE407)) >> cut
    two = mix(mix(before + np.uint64(0x9FB21C651E98DF25)) + ids) >> cut
    return one(ids), two, row


def pack(grams: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Sorted hashes as differences, of as many bytes as nearly all of them need, and both counts."""
    steps = np.diff(grams, prepend=np.uint64(0))
    width = 8 if len(steps) < 64 else max(1, -(-int(np.partition(steps, -len(steps) // 64)[-len(steps) // 64]).bit_length() // 8))
    wide = np.flatnonzero(steps >> np.uint64(4 * width) >> np.uint64(4 * width))
    body = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    found = [varints(np.array([len(grams), width, len(wide)])), varints(np.diff(wide, prepend=0)), varints(steps[wide]), body]
    return b"".join([*found, *[varints(c) for c in counts]])


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    (n, width, m), at = read_varints(raw, 0, 3)
    n, width = int(n), int(width)
    wide, at = read_varints(raw, at, int(m))
    values, at = read_varints(raw, at, int(m))
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = raw[at : at + n * width].reshape(n, width)
    steps = steps.view("<u8").ravel()
    steps[np.cumsum(wide).astype(np.int64)] = values
    one, at = read_varints(raw, at + n * width, n)
    two, at = read_varints(raw, at, n)
    return np.cumsum(steps, dtype=np.uint64), one.astype(np.int64), two.astype(np.int64)


def _block_rows(rows: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Ids and texts of a block's documents, and whether each is in the target, by the block's labels."""
    labels = rows.filter(pa.compute.equal(rows.column("kind"), 0)).column("doc_id")
    docs = rows.filter(pa.compute.equal(rows.column("kind"), 1)).combine_chunks()
    ids = docs.column("doc_id").combine_chunks()
    target = pa.compute.and_(pa.compute.is_in(ids, value_set=labels.combine_chunks().drop_null()), ids.is_valid())
    return ids, docs.column("text").combine_chunks(), np.asarray(target.to_numpy(zero_copy_only=False), bool)


def _counted(texts: pa.Array, target: np.ndarray, bits: int):
    """A block's different n-grams with both counts, the places of each word and bigram among them, and words' rows."""
    hashes, first = words(texts)
    one, two, row = ngrams(hashes, first, bits)
    starts = np.flatnonzero(np.diff(first) > 0)
    start = mix(np.array([_START]) + np.uint64(0xA24BAED4963EE407)) >> np.uint64(64 - bits)
    every = np.concatenate([one, two, np.repeat(start, len(starts))])
    inside = target[np.concatenate([row, row, starts])]
    known, place = np.unique(every, return_inverse=True)
    counts = (np.bincount(place[~inside], minlength=len(known)), np.bincount(place[inside], minlength=len(known)))
    return known, counts, place, row, first


def _edges(known: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where each part's n-grams begin in a sorted block (one more at the end)."""
    part = ((known >> np.uint64(max(0, bits - 32))) * np.uint64(parts)) >> np.uint64(min(32, bits))
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def _sends(parts: int, bits: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        _, texts, target = _block_rows(rows)
        known, counts, *_ = _counted(texts, target, bits)
        edges = _edges(known, parts, bits)
        some = np.flatnonzero(np.diff(edges))
        packed = [pack(known[a:b], (counts[0][a:b], counts[1][a:b])) for a, b in zip(edges[some], edges[some + 1], strict=True)]
        return pa.table({"part": pa.array(some, pa.int64()), "block": pa.array([key[0].as_py()] * len(some), pa.int64()), "grams": pa.array(packed, pa.binary())})

    return run


def _returns(key: tuple, rows: pa.Table) -> pa.Table:
    """For each block of a part: which of its n-grams others have too, a bit each, and their totals."""
    own = [unpack(x.as_py()) for x in rows.column("grams")]
    sizes = [len(x[0]) for x in own]
    known, place, times = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True, return_counts=True)
    totals = [np.bincount(place, np.concatenate([x[k] for x in own]), len(known)).astype(np.int64) for k in (1, 2)]
    out, at = [], 0
    for n in sizes:
        here = place[at : at + n]
        at += n
        shared = times[here] > 1
        here = here[shared]
        out.append(np.packbits(shared).tobytes() + varints(totals[0][here]) + varints(totals[1][here]))
    part = pa.array([key[0].as_py()] * len(out), pa.int64())
    return pa.table({"block": rows.column("block"), "part": part, "totals": pa.array(out, pa.binary())})


def _scores(background: int, target_words: int, parts: int, bits: int):
    size = (background, target_words)

    def run(key: tuple, rows: pa.Table, returned: pa.Table) -> pa.Table:
        ids, texts, target = _block_rows(rows)
        known, own, place, row, first = _counted(texts, target, bits)
        whole = [c.copy() for c in own]
        edges = _edges(known, parts, bits)
        for part, data in zip(returned.column("part").to_pylist(), returned.column("totals"), strict=True):
            raw, n = np.frombuffer(data.as_py(), np.uint8), int(edges[part + 1] - edges[part])
            shared = edges[part] + np.flatnonzero(np.unpackbits(raw, count=n))
            at = -(-n // 8)
            for k in (0, 1):
                whole[k][shared], at = read_varints(raw, at, len(shared))
        n, m = np.diff(first), len(row)
        # what the word's own document adds to each count is left out of its own model
        _, inverse, times = np.unique(place[: 2 * m] * np.int64(max(1, len(n))) + np.concatenate([row, row]), return_inverse=True, return_counts=True)
        at, less = {"one": place[:m], "two": place[m : 2 * m]}, {"one": times[inverse[:m]], "two": times[inverse[m:]]}
        # the word before, or a start sign, which a document has once
        heads = first[:-1][n > 0]
        for x, start in ((at, place[2 * m] if len(heads) else 0), (less, 1)):
            x["before"] = np.concatenate([x["one"][:1], x["one"][:-1]])
            x["before"][heads] = start
        means = []
        for k in (0, 1):
            belongs = target[row] == bool(k)
            count = {name: whole[k][at[name]] - np.where(belongs, less[name], 0) for name in at}
            total = size[k] - np.where(belongs, n[row], 0)
            p = (count["one"] + PRIOR / VOCABULARY) / (total + PRIOR)
            p = (count["two"] + PRIOR * p) / (count["before"] + PRIOR)
            loss = np.concatenate([[0.0], np.cumsum(-np.log(p))])
            means.append((loss[first[1:]] - loss[first[:-1]]) / np.maximum(n, 1))
        names = ("target_loss", "background_loss", "difference")
        columns = {c: pa.array(x, pa.float64(), mask=n == 0) for c, x in zip(names, (means[1], means[0], means[1] - means[0]), strict=True)}
        return pa.table({"doc_id": ids, "n_tokens": pa.array(n, pa.int64()), **columns})

    return run


def _sizes(documents: DataFrame) -> DataFrame:
    """doc_id, n (words) and bytes of each row."""

    def run(batches):
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            _, _, first = word_spans(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), pa.array(np.diff(offsets))], names=["doc_id", "n", "bytes"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, bytes long")


def cross_entropy_difference(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference (nats per word) of all documents.

    The target corpus is the documents labelled with quality 1 at least once. Without any its model
    is uniform. Null and empty texts, and others without words, have null losses; very long ones are
    scored whole. Repeated rows are scored and counted as often as they occur, and leave out only
    themselves; null ids are background. Other columns, whatever their names, are ignored; an empty
    table gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    marks = good.withColumn("_target", F.lit(1))
    sizes = _sizes(docs).groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).join(marks, "doc_id", "left")
    by = {r["t"]: r for r in sizes.groupBy(F.coalesce("_target", F.lit(0)).alias("t")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    total = [by[k]["n"] if k in by else 0 for k in (0, 1)]
    blocks = max(1, math.ceil(sum(r["bytes"] for r in by.values()) / BLOCK))
    parts = max(1, math.ceil(sum(total) / PART))
    bits = min(63, max(32, sum(total).bit_length() + SPARE_BITS))
    # labels go to the block of their document; a row without id has none and goes by its text
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).alias("block")
    rows = docs.select(block(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(1).alias("kind"), "doc_id", "text")
    rows = rows.unionByName(good.select(block(F.col("doc_id")), F.lit(0).alias("kind"), "doc_id", F.lit(None).cast("string").alias("text")))
    dealt = rows.groupBy("block")
    sent = dealt.applyInArrow(_sends(parts, bits), "part long, block long, grams binary")
    returned = sent.groupBy("part").applyInArrow(_returns, "block long, part long, totals binary")
    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double"
    return dealt.cogroup(returned.groupBy("block")).applyInArrow(_scores(*total, parts, bits), schema)
