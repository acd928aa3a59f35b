"""Toxicity by multiple-instance learning: sentences are judged, documents are labelled.

A sentence's score is the logistic of the weights of its hashed words and word beginnings; a
document's is the noisy-or of its sentences, 1 - prod(1 - p). Weights of telling features are trained from
document labels alone, by the gradient through the noisy-or, and the sentence scores
then locate what made a document toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, span_hashes, utf8, word_spans
from .language import remainder, sample, sample_hash

#: Hashed features.
FEATURES = 1 << 20
#: Besides whole words, their beginnings of so many bytes.
BEGINNINGS = (4, 5, 6)
#: The model is fitted on at most so many different texts of each class (the ones with the least hashes).
SAMPLE_PER_CLASS = 2_500
#: Documents are rejected from this score on.
THRESHOLD = 0.3
#: Sentences end at these bytes (. ! ? and line feed).
_END = np.zeros(256, dtype=bool)
_END[[10, 33, 46, 63]] = True


@dataclass(frozen=True)
class Instances:
    """Features of the words of a slice of texts (a row a word), with the sentence of each and the document of each sentence."""

    feature: np.ndarray
    sentence: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    stop: np.ndarray


def instances(array: pa.Array) -> Instances:
    """All sentences of all rows. ``first``: each row's first sentence (one more at the end);
    ``begin``, ``stop``: byte spans of sentences within the lower-cased row."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(array, "")))
    starts, ends, words_first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    # a sentence begins with a row's first word and with the first word after an end byte
    ended = np.concatenate([[0], np.cumsum(_END[data])])
    opens = np.ones(len(starts), bool)
    if len(starts):
        opens[1:] = ended[starts[1:]] != ended[starts[:-1]]
        opens[words_first[:-1][np.diff(words_first) > 0]] = True
    sentence = np.cumsum(opens) - 1
    opened = np.flatnonzero(opens)
    first = np.searchsorted(opened, words_first)
    row = np.repeat(np.arange(len(array)), np.diff(first))
    last = np.concatenate([opened[1:], [len(starts)]]) - 1 if len(opened) else opened
    # every word is a feature, and so are its beginnings: endings vary with grammar
    kinds = [span_hashes(data, starts, np.minimum(ends, starts + n)) + np.uint64(n) for n in BEGINNINGS]
    feature = (np.stack([hashes, *kinds], axis=1) & np.uint64(FEATURES - 1)).astype(np.int64)
    return Instances(feature, sentence, first, starts[opened] - offsets[row], ends[last] - offsets[row])


@dataclass(frozen=True)
class ToxicityModel:
    weight: np.ndarray
    bias: float

    def sentences(self, x: Instances) -> np.ndarray:
        total = np.bincount(x.sentence, self.weight[x.feature].sum(axis=1), minlength=int(x.first[-1])) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def documents(self, x: Instances, p: np.ndarray) -> np.ndarray:
        return noisy_or(p, x.first)


def noisy_or(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 - prod(1 - p) over each row's sentences; 0 for a row without any."""
    logs = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
    return np.clip(-np.expm1(logs[first[1:]] - logs[first[:-1]]), 0, 1)


def _telling(seen: np.ndarray, toxic: np.ndarray, rate: float) -> np.ndarray:
    """The features whose documents are toxic more often than chance among so many features gives.

    ``seen``, ``toxic``: documents and toxic documents with each feature; ``rate``: share of toxic
    ones. A feature is kept if its likelihood ratio against independence exceeds 2 ln(features seen).
    """
    term = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / np.maximum(b, 1e-9)), 0)
    ratio = 2 * (term(toxic, seen * rate) + term(seen - toxic, seen * (1 - rate)))
    return (toxic > seen * rate) & (ratio > 2 * np.log(max(2, int((seen > 0).sum()))))


def fit(labelled: DataFrame, most: int = SAMPLE_PER_CLASS, epochs: int = 60, ridge: float = 1e-5, rate: float = 0.1) -> ToxicityModel:
    """A model from rows with text and toxic (0 or 1); others are ignored.

    At most ``most`` rows of each class reach the driver; classes are weighted back to their
    true shares. Without both classes every score is 0.
    """
    usable = labelled.where("toxic in (0, 1) and text is not null").withColumn("toxic", F.col("toxic").cast("int"))
    rows, totals = sample(usable, "toxic", most)
    if len({r["toxic"] for r in rows}) < 2:
        return ToxicityModel(np.zeros(FEATURES), -30.0)
    y = np.array([r["toxic"] for r in rows], float)
    parts = [pa.array([r["text"] for r in rows[i : i + 100]], pa.string()) for i in range(0, len(rows), 100)]
    del rows
    seen, toxic = np.zeros(FEATURES), np.zeros(FEATURES)
    for i, part in enumerate(parts):
        x = instances(part)
        row = np.repeat(np.arange(len(part)), np.diff(x.first))
        pairs = np.unique(row[x.sentence][:, None] * FEATURES + x.feature)
        seen += np.bincount(pairs % FEATURES, minlength=FEATURES)
        toxic += np.bincount(pairs[y[100 * i + pairs // FEATURES] == 1] % FEATURES, minlength=FEATURES)
    usual = _telling(seen, toxic, y.mean())
    told = np.flatnonzero(usual)
    flat, spread, lengths, count = [], [], [], 0
    for part in parts:
        x = instances(part)
        inside = usual[x.feature]
        flat.append(np.searchsorted(told, x.feature[inside]))
        spread.append(count + np.broadcast_to(x.sentence[:, None], x.feature.shape)[inside])
        lengths.append(np.diff(x.first))
        count += int(x.first[-1])
    flat, spread, lengths = np.concatenate(flat), np.concatenate(spread), np.concatenate(lengths)
    first = np.concatenate([[0], np.cumsum(lengths)])
    row = np.repeat(np.arange(len(y)), lengths)
    drawn = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    share = np.where(y == 1, totals[1] / drawn[1], totals[0] / drawn[0])
    share = np.where(lengths > 0, share / share.mean(), 0)
    n, sentences = max(1, len(y)), count
    # the last entry is the bias
    weight, moment, square = np.append(np.zeros(len(told)), -6.0), np.zeros(len(told) + 1), np.zeros(len(told) + 1)
    for t in range(1, epochs + 1):  # full-batch Adam
        total = np.bincount(spread, weight[flat], minlength=sentences) + weight[-1]
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        whole = np.clip(noisy_or(p, first), 1e-6, 1 - 1e-6)
        # d loss / d total of a sentence = p (1 - y / P): all fall with a clean label, the likely ones rise with a toxic one
        slope = share[row] * p * (1 - (y / whole)[row]) / n
        gradient = np.append(np.bincount(flat, slope[spread], minlength=len(told)) + ridge * weight[:-1], slope.sum())
        moment, square = 0.9 * moment + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        weight = weight - rate * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
    whole = np.zeros(FEATURES, np.float32)
    whole[told] = weight[:-1]
    return ToxicityModel(whole, float(weight[-1]))


def score(df: DataFrame, model: ToxicityModel, keys: list[str], least: float = 0.5) -> DataFrame:
    """``keys`` with score, and the offending sentences: those of score ``least`` or more.

    offending is an array of (start, stop, score): UTF-8 byte spans in the lower-cased text.
    Null and empty texts score 0 and have none.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.select(*keys).schema
    names = [f.name for f in schema]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            x = instances(batch.column("text"))
            p = own.sentences(x)
            bad = np.flatnonzero(p >= least)
            found = [[] for _ in range(batch.num_rows)]
            row = np.searchsorted(x.first, bad, side="right") - 1
            for i, k in zip(row, bad, strict=True):
                found[i].append({"start": int(x.begin[k]), "stop": int(x.stop[k]), "score": float(p[k])})
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(own.documents(x, p)), pa.array(found, spans)], names=[*names, "score", "offending"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    kinds += ", score double, offending array<struct<start: long, stop: long, score: double>>"
    return df.select(*keys, "text").mapInArrow(run, kinds)


def train(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from the labels of documents whose crc32(doc_id) mod 4 is not 2."""
    known = labels.where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), 4) != 2)).select("doc_id", "toxic")
    # labels grow with the corpus: the plan that holds for large ones is used for all
    docs = documents.select("doc_id", "text", sample_hash().alias("_h"))
    return fit(docs.join(known.hint("merge"), "doc_id").select("text", "toxic", "_h"))


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents: doc_id, held_out, score, predicted, offending.

    Null and empty texts score 0; very long ones are read whole. A document with labels 0 and 1
    trains on both. Repeated rows and null ids are kept; a null id is not held out. Other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    found = score(documents.select("doc_id", "text"), train(documents, labels), ["doc_id"])
    return found.select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending",
    )
