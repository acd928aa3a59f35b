"""Benchmark decontamination by template canonicalisation.

Words of benchmark items and documents are canonicalised: numbers, names (capitalised words
inside a sentence) and units after a number become typed placeholders, neighbouring ones of a
kind one placeholder. Windows of WINDOW canonical tokens, half of them literal at least, are
hashed and joined; where a document shares enough of an item's windows on one alignment, the
slots of both are compared: values must replace each other consistently. So an item is found
whether it is copied or asked with other parameters. An item that has no window with enough
literal tokens is found by windows of its plain words, so only as a copy.

Items with the same template, and the same of their slots equal to each other, are one class, so
a template that many items share is matched once. Documents are read once to hash their windows;
a bitmap of fixed size, broadcast, drops those that no item can have, and the others are joined to
the items' windows by their hashes. Equal texts are matched once. Only texts with a match are read
again for their slots.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, folded, mix, slices, span_hashes, utf8, word_spans

#: Canonical tokens in a window (an item with fewer has one window of all).
WINDOW = 8
#: Shares of an item's windows, and of its slots, that must agree.
COVERAGE, CONSISTENCY = 0.3, 0.8
#: Bits of the bitmap that is broadcast; with more windows than bits it only drops fewer.
BITMAP = 1 << 24

# Measurement units that stand after a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons tonnes "
    "ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years cent cents dollar dollars euro euros percent degree degrees mph kmh watt watts volt volts"
).split()

NUMBER, NAME, UNIT = 1, 2, 3
_TYPED = np.array([0, 0xA5A5A5A5A5A5A5A1, 0xA5A5A5A5A5A5A5A2, 0xA5A5A5A5A5A5A5A3], np.uint64)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 58, 63]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 34, 39, 40]] = True


def _unit_hashes() -> np.ndarray:
    data, offsets = utf8(pa.array(UNITS))
    return np.unique(span_hashes(data, offsets[:-1], offsets[1:]))


@dataclass(frozen=True)
class Canonical:
    """Tokens of all rows (template hash, slot type or 0, value hash), and each row's first; plain words likewise."""

    template: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    first: np.ndarray
    word: np.ndarray
    first_word: np.ndarray


def canonicalise(array: pa.Array) -> Canonical:
    array = pc.fill_null(array, "")
    data, offsets = utf8(array)
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return Canonical(none, np.zeros(0, np.int64), none, first, none, first)
    low = folded(data)
    word = span_hashes(low, starts, ends)
    number = _DIGIT[data[starts]]
    capital = (data[starts] != low[starts]) | ((data[starts] == 0xC3) & (low[np.minimum(starts + 1, len(data) - 1)] != data[np.minimum(starts + 1, len(data) - 1)]))
    # a sentence opens a row, and after any stop between two words
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    opens = np.ones(len(starts), bool)
    opens[1:] = stops[starts[1:]] != stops[ends[:-1]]
    opens[first[:-1][np.diff(first) > 0]] = True
    kind = np.where(number, NUMBER, np.where(capital & ~opens, NAME, 0))
    unit = np.isin(word, _unit_hashes())
    follows = np.zeros(len(starts), bool)
    follows[1:] = number[:-1]
    follows[first[:-1][np.diff(first) > 0]] = False
    kind = np.where(unit & follows & (kind == 0), UNIT, kind)
    # neighbours of one kind are one slot: its value is a hash of all of them in order
    joins = np.zeros(len(starts), bool)
    joins[1:] = (kind[1:] > 0) & (kind[1:] == kind[:-1]) & ~(opens[1:] & (kind[1:] != NUMBER))
    joins[first[:-1][np.diff(first) > 0]] = False
    heads = np.flatnonzero(~joins)
    place = np.arange(len(starts)) - np.repeat(heads, np.diff(np.append(heads, len(starts))))
    value = np.add.reduceat(mix(word + place.astype(np.uint64)), heads)
    own = kind[heads]
    return Canonical(np.where(own > 0, _TYPED[own], word[heads]), own, value, np.searchsorted(heads, first), word, first)


def windows(token: np.ndarray, kind: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window that starts at each token, and whether it lies in a row and is half literal."""
    n = len(token)
    if n < width:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    total, slots = np.full(n - width + 1, width, np.uint64), np.zeros(n - width + 1, np.int64)
    for j in range(width):
        total += mix(token[j : n - width + 1 + j] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (1 << 64) - 1))
        slots += kind[j : n - width + 1 + j] > 0
    row_end = np.repeat(first[1:], np.diff(first))[: n - width + 1]
    good = (np.arange(n - width + 1) + width <= row_end) & (2 * slots <= width)
    tail = np.zeros(width - 1, bool)
    return np.concatenate([mix(total), np.zeros(width - 1, np.uint64)]), np.concatenate([good, tail])


def _families(x: Canonical) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens, kinds and rows' firsts of templates (family 0) and of plain words (1), whose hashes never meet."""
    return [(x.template, x.kind, x.first), (x.word ^ np.uint64(0x5DEECE66D1234567), np.zeros(len(x.word), np.int64), x.first_word)]


def _pattern(values: np.ndarray) -> np.ndarray:
    """Each value as the place at which it is first met."""
    _, at, inverse = np.unique(values, return_index=True, return_inverse=True)
    return at[inverse]


def _value_hash(kind: np.ndarray, value: np.ndarray) -> int:
    slots = np.flatnonzero(kind > 0)
    terms = mix(value[slots] + slots.astype(np.uint64))
    return int(mix(terms.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


_ITEM = "item_id long, class long, family int, width int, size int, value_hash long, kind array<int>, pattern array<int>, hashes array<long>, places array<int>"


def describe_items(benchmark: DataFrame) -> DataFrame:
    """Items with their class, windows and slots; items without words have none and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = canonicalise(batch.column("text"))
            rows = []
            for k in range(batch.num_rows):
                for family, (token, kind, first) in enumerate(_families(x)):
                    token, kind = token[first[k] : first[k + 1]], kind[first[k] : first[k + 1]]
                    n = len(token)
                    if not n:
                        break
                    hashes, good = windows(token, kind, np.array([0, n]), min(n, WINDOW))
                    at = np.flatnonzero(good)
                    if not len(at):
                        continue
                    value = x.value[x.first[k] : x.first[k + 1]] if family == 0 else token
                    slots = np.flatnonzero(kind > 0)
                    pattern = np.zeros(n, np.int64)
                    pattern[slots] = _pattern(value[slots])
                    place = np.arange(n, dtype=np.uint64)
                    own = mix(mix(token + place) + mix(pattern.astype(np.uint64) + place)).sum(dtype=np.uint64, keepdims=True)
                    rows.append((batch.column("item_id")[k].as_py(), int(mix(own + np.uint64(n)).view(np.int64)[0]), family, min(n, WINDOW), n, _value_hash(kind, value), kind.tolist(), pattern.tolist(), hashes[at].view(np.int64).tolist(), at.tolist()))
                    break
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _ITEM.split(", ")])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, _ITEM)


def bitmap(hashes: DataFrame, bits: int = BITMAP) -> np.ndarray:
    """A bitmap of the column ``hash``; each task sends its own, and the driver joins them one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            own[batch.column("hash").to_numpy().view(np.uint64) % np.uint64(bits)] = True
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()], pa.binary())], names=["bits"])

    whole = np.zeros(bits // 8, np.uint8)
    for row in hashes.select("hash").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        whole |= np.frombuffer(row["bits"], np.uint8)
    return whole


def _text_keys() -> list:
    return [F.xxhash64("text").alias("key"), F.hash("text").alias("key2")]


def window_hits(texts: DataFrame, known: np.ndarray, used: list[tuple[int, int]]) -> DataFrame:
    """key, key2, hash, at: windows of texts, of the families and widths ``used``, that the bitmap doesn't rule out."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in slices(batches):
            families = _families(canonicalise(batch.column("text")))
            for family, width in used:
                token, kind, first = families[family]
                hashes, good = windows(token, kind, first, width)
                at = np.flatnonzero(good)
                at = at[bits[hashes[at] % np.uint64(len(bits))]]
                row = np.searchsorted(first, at, side="right") - 1
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(taken), batch.column("key2").take(taken), pa.array(hashes[at].view(np.int64)), pa.array((at - first[row]).astype(np.int32))],
                    names=["key", "key2", "hash", "at"],
                )

    return texts.mapInArrow(run, "key long, key2 int, hash long, at int")


def slot_agreement(kind: np.ndarray, mine: np.ndarray, other_kind: np.ndarray, theirs: np.ndarray) -> tuple[int, float]:
    """Slots compared, and the share that replace consistently.

    A slot is consistent if its type agrees and its value goes to the value that most of the
    item's slots with it go to, and back.
    """
    slots = np.flatnonzero((kind > 0) & (other_kind > 0))
    if not len(slots):
        return 0, 1.0
    there, back = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
    pairs = [(int(kind[i]), int(mine[i]), int(other_kind[i]), int(theirs[i])) for i in slots]
    for a, u, b, v in pairs:
        there[a, u][b, v] += 1
        back[b, v][a, u] += 1
    top = lambda d: max(sorted(d), key=d.get)
    good = sum(a == b and top(there[a, u]) == (b, v) and top(back[b, v]) == (a, u) for a, u, b, v in pairs)
    return len(slots), good / len(slots)


_SLOTS = "key long, key2 int, class long, first_token int, matched long, n_windows long, slots long, consistency double, value_hash long"


def _compare_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x, rows = canonicalise(batch.column("text")), []
        for k, found in enumerate(batch.column("found").to_pylist()):
            kind, value = x.kind[x.first[k] : x.first[k + 1]], x.value[x.first[k] : x.first[k + 1]]
            for m in found:
                line, own, pattern = m["line"], np.array(m["kind"]), np.array(m["pattern"])
                slots, share, value_hash = 0, 1.0, _value_hash(own, np.zeros(len(own), np.uint64))
                if m["family"] == 0:
                    a, b = max(line, 0), min(line + len(own), len(kind))
                    slots, share = slot_agreement(own[a - line : b - line], pattern[a - line : b - line], kind[a:b], value[a:b])
                    value_hash = _value_hash(kind[a:b], value[a:b])
                rows.append((batch.column("key")[k].as_py(), batch.column("key2")[k].as_py(), m["class"], line, m["matched"], m["n_windows"], slots, share, value_hash))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _SLOTS.split(", ")])


def match_texts(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """key, key2 (of a different text), item_id, n_items and the measures of the match.

    An item is named if its slots have the text's values, each of them if several have; else the
    least item_id stands for the n_items of its class.
    """
    items = cut(describe_items(benchmark))
    classes = cut(
        items.groupBy("class").agg(
            F.min("item_id").alias("least_id"), F.count(F.lit(1)).alias("n_items"),
            F.max_by(F.struct("family", "kind", "pattern", "hashes", "places"), F.lit(0)).alias("own"),
        ).select("class", "least_id", "n_items", "own.*")
    )
    known = classes.select("class", F.size("hashes").cast("long").alias("n_windows"), F.inline(F.arrays_zip("hashes", "places")).alias("hash", "place"))
    used = sorted((r["family"], r["width"]) for r in items.select("family", "width").distinct().collect())
    texts = documents.where("text is not null").select(*_text_keys(), "text")
    hits = window_hits(texts, bitmap(known), used).distinct()
    # where an item's window comes twice in it, each of its places counts
    lines = hits.join(known, "hash").groupBy("key", "key2", "class", "n_windows", (F.col("at") - F.col("place")).alias("line")).agg(F.collect_set("place").alias("places"))
    lines = cut(lines)
    best = lines.groupBy("key", "key2", "class").agg(F.min(F.struct((-F.size("places")).alias("n"), "line")).alias("b")).select("key", "key2", "class", F.col("b.line").alias("best"))
    # an inserted or lost token shifts the alignment a little: lines near the best count too
    near = lines.join(best, ["key", "key2", "class"]).where(F.abs(F.col("line") - F.col("best")) <= WINDOW)
    near = near.groupBy("key", "key2", "class", "n_windows", "best").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("matched"))
    near = near.where(F.col("matched") >= coverage * F.col("n_windows"))
    found = near.join(classes.select("class", "family", "kind", "pattern"), "class").groupBy("key", "key2").agg(
        F.collect_list(F.struct("class", "family", "kind", "pattern", F.col("best").alias("line"), "matched", "n_windows")).alias("found")
    )
    found = cut(found)
    held = texts.join(found.select("key", "key2"), ["key", "key2"], "left_semi").dropDuplicates(["key", "key2"])
    slots = held.join(found, ["key", "key2"]).mapInArrow(_compare_slots, _SLOTS).where(F.col("consistency") >= consistency)
    named = items.select("class", "value_hash", "item_id", F.lit(True).alias("named"))
    rows = slots.join(named, ["class", "value_hash"], "left").join(classes.select("class", "least_id", "n_items"), "class")
    return rows.select(
        "key", "key2", F.when(F.col("named"), F.col("item_id")).otherwise(F.col("least_id")).alias("item_id"), "n_items", "matched", "n_windows",
        (F.col("matched") / F.col("n_windows")).alias("coverage"), "first_token", "slots", "consistency",
        (F.coalesce("named", F.lit(False)) & (F.col("matched") == F.col("n_windows"))).alias("exact"),
    )


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item, or class of items, that it holds: doc_id, item_id and measures.

    Equal items are found each. Null and empty texts match nothing; very long ones are searched
    whole; an item without words can't be found. Repeated rows and null ids are reported as often as
    they occur; of alignments with as many windows the first counts. Other columns, whatever their
    names, are ignored; an empty table on either side gives an empty result.
    """
    found = match_texts(documents, benchmark)
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_keys())
    return ids.join(found, ["key", "key2"]).drop("key", "key2")


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text holds no benchmark item, all columns as they were, whatever their names.

    Rows go by their own text, so repeated and null ids do no harm; null texts stay.
    """
    found = cut(match_texts(documents, benchmark).select("key", "key2").distinct())
    whole = documents.select(*_text_keys(), F.struct(*documents.columns).alias("row"), "text")
    left = whole.join(found.withColumn("text", F.lit("")), (whole["key"] == found["key"]) & (whole["key2"] == found["key2"]) & whole["text"].isNotNull(), "left_anti")
    return left.select("row.*")
