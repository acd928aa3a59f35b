"""Language identification by the nearest of several centroids per language.

Texts become vectors of hashed character n-grams (1 to 3 bytes of letters and word
ends, after lower-casing), weighted by log term frequency and inverse document
frequency and normalised. Spherical k-means gives each language several centroids; a
text gets the language of the centroid with the largest cosine. A text whose cosine is
below the language's own rejection distance is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, slices, utf8

UNKNOWN = "und"
#: Hashed n-gram dimensions.
DIMENSIONS = 1 << 12
#: The model is fitted on at most so many different texts per language (the ones with the least hashes),
#: none of them of more bytes than SAMPLE_TEXT.
SAMPLE_PER_LANGUAGE, SAMPLE_TEXT = 600, 1 << 17
#: Centroids per language, and the share of training texts farther away than the rejection distance.
CENTROIDS, REJECTED_SHARE = 4, 0.001

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def counts(array: pa.Array, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of each row, and whether it has letters. Whole texts are counted."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(array, "")))
    letter = _LETTER[data]
    # runs of anything else count as one word end
    symbol = np.where(letter, data, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = np.zeros((len(array), dimensions), np.float32)
    lettered = pc.fill_null(pc.match_substring_regex(array, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    some = np.zeros(len(array), bool)
    mask = np.uint64(dimensions - 1)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        x = symbol[a:b][keep[a:b]]
        if not lettered[i]:
            continue
        some[i] = True
        x = np.concatenate([[np.uint64(32)], x])
        two = x[1:] + (x[:-1] << np.uint64(8))
        grams = [x, two + np.uint64(1 << 20)]
        if len(x) > 2:
            grams.append(two[1:] + (x[:-2] << np.uint64(16)) + np.uint64(1 << 30))
        for g in grams:
            out[i] += np.bincount((mix(g) & mask).astype(np.int64), minlength=dimensions)
    return out, some


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        x = np.log1p(grams) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def nearest(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine, and whether it is farther than the rejection distance."""
        cosine = self.vectors(grams) @ self.centroids.T
        best = cosine.argmax(axis=1)
        near = cosine[np.arange(len(best)), best]
        language = self.owner[best]
        return language, near, near < self.floor[language]


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    centres = x[[int(rng.integers(len(x)))]]
    while len(centres) < k:  # farthest first
        centres = np.vstack([centres, x[[int((x @ centres.T).max(axis=1).argmin())]]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for j in range(k):
            if (own == j).any():
                centre = x[own == j].sum(axis=0)
                centres[j] = centre / max(float(np.linalg.norm(centre)), 1e-9)
    return centres


def sample_hash(longest: int = SAMPLE_TEXT) -> Column:
    """What ``sample`` draws by; taken before a join with labels, only hashes are exchanged to count them."""
    return F.when(F.octet_length("text") <= longest, F.xxhash64("text", F.lit(17)))


def sample(rows: DataFrame, label: str, most: int, longest: int = SAMPLE_TEXT) -> tuple[list, dict]:
    """At most ``most`` different texts of each label value, those with the least hashes, and rows by label.

    Texts of more than ``longest`` bytes are not drawn, so what reaches the driver is bounded in
    bytes as well. A text counts once however often it occurs, so copies don't crowd the sample.
    """
    hashed = rows if "_h" in rows.columns else rows.withColumn("_h", sample_hash(longest))
    sizes = hashed.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("_h", 0.02).alias("d")).collect()
    totals = {r[label]: r["n"] for r in sizes}
    if not totals:
        return [], totals
    edges = []
    for row in sizes:
        share = min(1.0, (1.2 * most + 5 * most**0.5 + 20) / max(1, row["d"]))
        edges.append((row[label], int((share * 2 - 1) * (1 << 63)) if share < 1 else (1 << 63) - 1))
    kind = rows.schema[label].dataType.simpleString()
    bound = F.broadcast(rows.sparkSession.createDataFrame(edges, f"{label} {kind}, _edge long"))  # a row a label
    near = hashed.where(F.col("_h") <= max(e for _, e in edges)).join(bound, label).where("_h <= _edge").groupBy(label, "_h").agg(F.min("text").alias("text"))
    first = Window.partitionBy(label).orderBy("_h", "text")
    kept = near.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most).orderBy(label, "_k")
    return kept.select(label, "text").toArrow().to_pylist(), totals


def fit(labelled: DataFrame, most: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS, seed: int = 5) -> LanguageModel:
    """A model from rows with text and lang; rows without either are ignored.

    The sample that reaches the driver is at most ``most`` rows a language. Without rows the
    model has no language.
    """
    rows, _ = sample(labelled.where("lang is not null and text is not null and text != ''"), "lang", most)
    languages = tuple(sorted({r["lang"] for r in rows}))
    grams, some = counts(pa.array([r["text"] for r in rows], pa.string()))
    names = np.array([languages.index(r["lang"]) for r in rows], int)
    grams, names = grams[some], names[some]
    idf = np.log((1 + len(grams)) / (1 + (grams > 0).sum(axis=0))).astype(np.float32) + 1
    blank = LanguageModel(languages, idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(len(languages)))
    x, rng = blank.vectors(grams).astype(np.float32), np.random.default_rng(seed)
    centres, owner = [], []
    for k in range(len(languages)):
        if (names == k).any():
            found = _k_means(x[names == k], centroids, rng)
            centres.append(found)
            owner += [k] * len(found)
    if not centres:
        return LanguageModel((), idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    centres, owner = np.vstack(centres).astype(np.float32), np.array(owner)
    floor = np.zeros(len(languages))
    for k in range(len(languages)):
        if (names == k).any():
            own = (x[names == k] @ centres[owner == k].T).max(axis=1)
            floor[k] = np.quantile(own, REJECTED_SHARE) * 0.8
    return LanguageModel(languages, idf, centres, owner, floor)


def predict(df: DataFrame, model: LanguageModel, keys: list[str]) -> DataFrame:
    """``keys`` with lang_pred, score and rejected.

    lang_pred is ``und`` for null texts and texts without letters (score 0, rejected), else
    the nearest centroid's language; score is its cosine, in 0 to 1; rejected marks texts
    beyond the rejection distance.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.select(*keys).schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            grams, some = counts(batch.column("text"))
            some &= bool(own.languages)
            language, score, rejected = np.zeros(len(some), int), np.zeros(len(some)), np.ones(len(some), bool)
            if some.any():
                language[some], score[some], rejected[some] = own.nearest(grams[some])
            label = [own.languages[k] if s else UNKNOWN for k, s in zip(language, some, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(label, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(rejected)],
                names=[*names, "lang_pred", "score", "rejected"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return df.select(*keys, "text").mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; 0 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0))


def identify(documents: DataFrame) -> DataFrame:
    """Predictions for all documents, learned from those whose crc32(doc_id) mod 5 is not 0.

    Null and empty texts are ``und``. Very long texts are counted whole. Of centroids with the same
    cosine the first language in alphabetical order counts. Repeated rows and null ids (held out)
    are kept; other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    docs = documents.select("doc_id", "text", "lang")
    fold = remainder(F.col("doc_id"), 5)
    model = fit(docs.where(fold != 0).select("text", "lang"))
    found = predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "rejected")
