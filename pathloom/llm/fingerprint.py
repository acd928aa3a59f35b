"""Document fingerprints: a homomorphic multiset hash, in DataFrame expressions only.

A text is the multiset of its paragraphs (the pieces between line feeds). Each
paragraph is hashed to a wide vector and the vectors are summed, so equal
multisets have equal sums in any order, and a paragraph is inserted or deleted
by adding or subtracting its vector.

* 8 identity lanes modulo 2**32: the eight 32-bit words of the paragraph's SHA-256.
* 128 likeness lanes modulo 2**16: each run of three words within the paragraph
  adds 1 or -1 to every lane, by the bits of its hash. The cosine of two texts'
  lanes (as signed numbers) estimates the cosine of their run counts, with a
  standard error of about 0.09 for unrelated texts.

A fingerprint is the lanes in hexadecimal: 512 characters of likeness lanes, then
64 of identity lanes. Null texts count as empty; an empty text is one empty
paragraph. Fingerprints ignore the order of paragraphs by design.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Packed sums: each long holds two lanes of 32 bits, so that no text overflows one.
PACKED = 64
LANES = 2 * PACKED
IDENTITY = 8
_PAIR = (1 << 32) + 1
_LOW = (1 << 32) - 1


def _hex(x: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(x)), width, "0")


def identity_lanes(text: Column) -> Column:
    """64 hexadecimal characters: sums of the paragraphs' SHA-256 words modulo 2**32."""
    digests = F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 256))
    zero = F.array(*[F.lit(0).cast("long")] * IDENTITY)
    lanes = F.aggregate(
        digests,
        zero,
        lambda acc, h: F.transform(
            acc,
            lambda x, i: (x + F.conv(F.substr(h, i * 8 + 1, F.lit(8)), 16, 10).cast("long")).bitwiseAND(F.lit(_LOW)),
        ),
    )
    return F.array_join(F.transform(lanes, lambda x: _hex(x, 8)), "")


def likeness_sums(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` with ``likeness_lanes``, an array of 128 numbers modulo 2**16.

    ``keys`` must identify rows. Rows already partitioned by some of the keys are
    summed where they are; otherwise partial sums, one row a text, are exchanged.
    """
    paragraphs = df.select(*keys, F.explode(F.split(F.col(text), "\n", -1)).alias("_p"))
    split = paragraphs.select(*keys, F.split("_p", " ", -1).alias("_w"))
    runs = split.select(
        *keys,
        F.inline(
            F.arrays_zip(
                F.col("_w").alias("a"),
                F.slice("_w", 2, F.size("_w")).alias("b"),
                F.slice("_w", 3, F.size("_w")).alias("c"),
            )
        ).alias("_a", "_b", "_c"),
    )
    hashed = runs.select(*keys, F.xxhash64("_a", "_b", "_c").alias("_h"))
    hashed = hashed.select(*keys, "_h", F.xxhash64("_h").alias("_g"))
    sums = [
        F.sum(F.shiftrightunsigned(h, s).bitwiseAND(F.lit(_PAIR))).alias(f"_s{h}{s}") for h in ("_h", "_g") for s in range(32)
    ]
    summed = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *sums)
    packed = F.array(*[F.col(f"_s{h}{s}") for h in ("_h", "_g") for s in range(32)])
    ones = F.concat(
        F.transform(packed, lambda x: x.bitwiseAND(F.lit(_LOW))), F.transform(packed, lambda x: F.shiftrightunsigned(x, 32))
    )
    return summed.select(*keys, F.transform(ones, lambda x: (2 * x - F.col("_n")).bitwiseAND(F.lit(0xFFFF))).alias("likeness_lanes"))


def as_text(likeness_lanes: Column, identity: Column) -> Column:
    return F.concat(F.array_join(F.transform(likeness_lanes, lambda x: _hex(x, 4)), ""), identity)


def lanes_of(fingerprint: Column) -> Column:
    """The likeness lanes of a fingerprint in text form."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(LANES - 1)),
        lambda i: F.conv(F.substr(fingerprint, i * 4 + 1, F.lit(4)), 16, 10).cast("long"),
    )


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """The fingerprint of the union (``sign`` 1) or difference (-1) of two paragraph multisets."""
    likeness = F.zip_with(lanes_of(left), lanes_of(right), lambda a, b: (a + sign * b).bitwiseAND(F.lit(0xFFFF)))
    at = lambda x, i: F.conv(F.substr(x, i * 8 + LANES * 4 + 1, F.lit(8)), 16, 10).cast("long")
    identity = F.transform(
        F.sequence(F.lit(0), F.lit(IDENTITY - 1)),
        lambda i: _hex((at(left, i) + sign * at(right, i)).bitwiseAND(F.lit(_LOW)), 8),
    )
    return as_text(likeness, F.array_join(identity, ""))


def _signed(lanes: Column) -> Column:
    return F.transform(lanes, lambda x: F.when(x >= 0x8000, x - 0x10000).otherwise(x).cast("double"))


def likeness(left: Column, right: Column) -> Column:
    """0 to 1 for two lane arrays: their cosine where positive, and exactly 1 for equal lanes."""
    a, b = _signed(left), _signed(right)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(a, lambda x: x * x)) * total(F.transform(b, lambda x: x * x)))
    cosine = F.when(norm > 0, dot / F.when(norm > 0, norm)).otherwise(0.0)
    return F.when(left == right, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def fingerprint_documents(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the ``fingerprint`` of each row's text. ``keys`` must identify rows."""
    base = df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    wide = base.select(*keys, identity_lanes(F.col("_text")).alias("_identity"), "_text")
    sums = likeness_sums(wide, [*keys, "_identity"], "_text")
    return sums.select(*keys, as_text(F.col("likeness_lanes"), F.col("_identity")).alias("fingerprint"))


def ordered_parts(df: DataFrame, key: str, parts: int) -> tuple[list[int | None], Column]:
    """Starts of up to ``parts`` ranges of ``key`` with about equally many rows, and the range's number.

    Each start is a value of ``key``; the first is null where some keys are. ``parts`` bounds
    what reaches the driver.
    """
    steps = [i / parts for i in range(parts)]
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(key).alias("filled"),
        F.min(key).alias("least"),
        F.percentile_approx(key, steps, F.lit(max(10_000, 10 * parts))).alias("starts"),
    ).first()
    starts: list[int | None] = sorted({row["least"], *(row["starts"] or [])} - {None})
    if row["filled"] < row["n"]:
        starts = [None, *starts]
    some = [x for x in starts if x is not None]
    width = max(1, int(len(some) ** 0.5))
    if not some:
        return starts, F.lit(0)
    coarse = F.array(*[F.lit(x) for x in some[::width]])
    fine = F.array(*[F.array(*[F.lit(x) for x in some[i : i + width]]) for i in range(0, len(some), width)])
    within = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col(key)))
    block = F.greatest(within(coarse), F.lit(1))
    number = (block - 1) * width + within(F.element_at(fine, block)) - 1 + (1 if starts[0] is None else 0)
    return starts, F.when(F.col(key).isNull(), 0).otherwise(number)


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with likenesses.

    In the edited text the last floor(n_chars / 4) code points are replaced by the first as
    many of the next document by ascending ``doc_id`` (after the last: the first). Null ids
    come first; rows with one id are ordered by a hash of their text, then their text. Every
    row is kept, repeated ones too; an empty table gives an empty result. Other columns,
    whatever their names, are ignored.

    Rows move once, to ranges of ``doc_id``; the first rows of each range are also sent to the
    range before it, so that every next document is at hand. Sums are formed in place.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = min(4 * shuffle_partitions(spark), 16_384)
    starts, number = ordered_parts(docs, "doc_id", parts)
    rows = docs.withColumn("_part", number).withColumn("_after", F.lit(0))
    if not starts:
        starts = [None]
    before = [(x, (k - 1) % len(starts)) for k, x in enumerate(starts)]
    heads = [docs.where(F.col("doc_id").isNull()).withColumn("_part", F.lit(p)) for x, p in before if x is None]
    if some := [(x, p) for x, p in before if x is not None]:
        lead = spark.createDataFrame(some, "_start long, _part int")
        heads.append(docs.join(F.broadcast(lead), F.col("doc_id") == F.col("_start")).select("doc_id", "text", "_part"))
    rows = reduce(DataFrame.unionByName, [rows, *[h.withColumn("_after", F.lit(1)) for h in heads]])

    order = Window.partitionBy("_part").orderBy("_after", F.col("doc_id").asc_nulls_first(), "_tie", "text")
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    rows = rows.select(
        "_part", "_after", "doc_id", "text", F.row_number().over(order).alias("_row"), F.lead("text").over(order).alias("_next")
    )
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    swap = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - swap).cast("int")), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), swap)
    )
    versions = F.array(
        F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), edited.alias("t"))
    )
    both = rows.select("_part", "_row", "_after", "doc_id", "n_chars", F.inline(versions).alias("_v", "_t"))
    both = both.where("_after = 0 or _v = 0").select(
        "_part", "_row", "_after", "doc_id", "n_chars", "_v",
        F.when(F.col("_v") == 1, F.sha2("_t", 256)).alias("_sha"), identity_lanes(F.col("_t")).alias("_identity"), "_t",
    )
    keys = ["_part", "_row", "_after", "doc_id", "n_chars", "_v", "_sha", "_identity"]
    sums = likeness_sums(both, keys, "_t")
    place = Window.partitionBy("_part").orderBy("_row", "_v")
    ahead = sums.select(
        "_after", "_v", "doc_id", "n_chars", "likeness_lanes", "_identity",
        F.lead("_sha", 1).over(place).alias("edited_sha256"),
        F.lead("likeness_lanes", 1).over(place).alias("_edited"),
        F.lead("_identity", 1).over(place).alias("_edited_identity"),
        F.lead("likeness_lanes", 2).over(place).alias("_following"),
    )
    return ahead.where("_after = 0 and _v = 0").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("likeness_lanes"), F.col("_identity")).alias("fingerprint"),
        as_text(F.col("_edited"), F.col("_edited_identity")).alias("edited_fingerprint"),
        likeness(F.col("likeness_lanes"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("likeness_lanes"), F.col("_following")).alias("near_next"),
    )
