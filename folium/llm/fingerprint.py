"""Homomorphic multiset fingerprints of documents.

A text is a multiset of paragraphs.  Each paragraph is hashed to a vector of 16 numbers below 2**32, and the vectors are summed
modulo 2**32: the sum doesn't depend on order, and a paragraph is put in or taken out by one addition or subtraction.  So
that edits inside a paragraph show as well, paragraphs are cut into pieces where a hash of a word says so (about eight words),
and pieces are summed modulo 2**8 into sparse lanes: a piece adds an odd number to one of 64 lanes, at each of six levels;
level k only takes the pieces whose hash ends in 2k zero bits, so that one level suits texts of any length.  Three counters
modulo 2**32 hold the numbers of paragraphs, pieces and code points.

``likeness`` estimates the Jaccard likeness of two texts' pieces from two fingerprints alone: with D differing pieces at
a level, a lane stays equal with probability (1 - 1/64)**D.

Defined results: null text is empty; equal texts have equal fingerprints; two empty texts have likeness 1, an empty and another
text 0.  Neighbours are taken in descending doc_id, null last, rows with one doc_id in the order of their texts' hashes; after the
last document comes the first; a document alone is its own neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DENSE, LANES, LEVELS, CUT = 16, 64, 6, 8
_SIZE = 4 * (DENSE + 3) + LANES * LEVELS


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pieces(text: str) -> np.ndarray:
    """A 64-bit hash of each piece of each paragraph of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    line, blank = points == 10, (points == 32) | ((points >= 9) & (points <= 13))
    first = ~blank & np.concatenate(([True], blank[:-1]))
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64)
    # A word's hash sums its code points, each mixed with its place in the word.
    word = np.cumsum(first) - 1
    place = (np.arange(len(points)) - starts[np.maximum(word, 0)]).astype(np.uint64)
    mixed = _mix(points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place)
    mixed[blank] = 0
    words = _mix(np.add.reduceat(mixed, starts))
    lines = np.cumsum(line)[starts]
    begins = np.ones(len(words), bool)
    begins[1:] = (words[:-1] % np.uint64(CUT) == 0) | (lines[1:] != lines[:-1])
    at = np.flatnonzero(begins)
    order = (np.arange(len(words)) - at[np.cumsum(begins) - 1]).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(words + order * np.uint64(0xD6E8FEB86659FD93)), at))


class Multiset:
    """A fingerprint that paragraphs can be added to and removed from."""

    def __init__(self, text: str | None = None):
        self.dense = np.zeros(DENSE + 3, np.uint32)
        self.lanes = np.zeros(LANES * LEVELS, np.uint8)
        if text:
            self.add(text)

    def add(self, text: str, sign: int = 1) -> "Multiset":
        paragraphs = text.split("\n")
        pieces = _pieces(text)
        hashed = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=4 * DENSE).digest() for p in paragraphs)
        change = np.zeros(DENSE + 3, np.uint32)
        change[:DENSE] = np.frombuffer(hashed, "<u4").reshape(-1, DENSE).sum(axis=0, dtype=np.uint32)
        change[DENSE:] = [len(paragraphs), len(pieces), sum(map(len, paragraphs)) & 0xFFFFFFFF]
        lanes = np.zeros(LANES * LEVELS, np.int64)
        value = ((pieces >> np.uint64(56)) | np.uint64(1)).astype(np.int64)
        lane = ((pieces >> np.uint64(40)) % np.uint64(LANES)).astype(np.int64)
        for level in range(LEVELS):
            taken = pieces & np.uint64((1 << 2 * level) - 1) == 0
            if not taken.any():
                break
            lanes[level * LANES : (level + 1) * LANES] = np.bincount(lane[taken], value[taken], LANES)
        self.dense += change if sign > 0 else np.uint32(0) - change
        self.lanes += (sign * lanes).astype(np.uint8)
        return self

    def remove(self, text: str) -> "Multiset":
        return self.add(text, -1)

    def hex(self) -> str:
        return (self.dense.astype("<u4").tobytes() + self.lanes.tobytes()).hex()

    @classmethod
    def from_hex(cls, text: str) -> "Multiset":
        raw, found = bytes.fromhex(text), cls()
        found.dense = np.frombuffer(raw[: 4 * (DENSE + 3)], "<u4").copy()
        found.lanes = np.frombuffer(raw[4 * (DENSE + 3) :], np.uint8).copy()
        return found


def likeness(a: Multiset, b: Multiset) -> float:
    if (a.dense == b.dense).all() and (a.lanes == b.lanes).all():
        return 1.0
    n = int(a.dense[DENSE + 1]) + int(b.dense[DENSE + 1])
    if not n or not (a.dense[DENSE + 1] and b.dense[DENSE + 1]):
        return 0.0
    equal = (a.lanes == b.lanes).reshape(LEVELS, LANES).mean(axis=1)
    fit = np.flatnonzero(equal >= 0.2)
    level = int(fit[0]) if len(fit) else LEVELS - 1
    differ = min(float(n), np.log(max(equal[level], 0.5 / LANES)) / np.log(1 - 1 / LANES) * 4.0**level)
    return float((n - differ) / (n + differ))


def neighbours(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text, tie, tail): documents in ranges of descending doc_id, null last, rows of one doc_id by a hash of their
    text, whatever range they are in.  The rows that may be the first of a range also stand, as tail, behind the range before it (the
    first range's behind the last), so that each range is worked on alone."""
    spark = docs.sparkSession
    n = common.partitions(spark)
    rows = docs.select("doc_id", common.text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("id"), F.col("tie"))
    # About 64 keys a range, chosen by a hash: what comes to the driver grows with the partitions, not with the corpus.
    every = max(1, docs.count() // (64 * n))
    sample = sorted(tuple(r[0]) for r in rows.select(key.alias("key")).where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).collect()) if n > 1 else []
    cuts = sorted({sample[len(sample) * k // n] for k in range(1, n)}) if sample else []
    literal = F.array(*[F.struct(F.lit(a).alias("none"), F.lit(b).cast("long").alias("id"), F.lit(c).cast("long").alias("tie")) for a, b, c in cuts])
    # Range 0 has the largest ids.
    rows = rows.withColumn("key", key).withColumn("part", F.size(F.filter(literal, lambda c: c <= F.col("key"))) if cuts else F.lit(0))
    heads = {r[0]: tuple(r[1]) for r in rows.groupBy("part").agg(F.min("key")).collect()}
    order = sorted(heads)
    # One row a range, whatever the corpus.
    behind = spark.createDataFrame([(p, heads[p], order[k - 1]) for k, p in enumerate(order)], "part int, head struct<none:boolean,id:bigint,tie:bigint>, before int")
    marked = rows.join(F.broadcast(behind), "part", "left")
    first = F.when(F.col("key") == F.col("head"), F.struct(F.col("before").alias("part"), F.lit(True).alias("tail")))
    places = F.filter(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("tail")), first), lambda x: x.isNotNull())
    return marked.select("doc_id", "text", "tie", F.explode(places).alias("x")).select("x.part", "doc_id", "text", "tie", "x.tail")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third (of code points, rounded down) replaced by the
    beginning of the next document, as much or all of it."""
    spark = common.prepare(docs.sparkSession)
    rows = neighbours(docs)
    order = [F.col("part"), F.col("tail"), F.col("doc_id").desc_nulls_last(), F.col("tie")]
    rows = rows.repartitionById(common.partitions(spark), "part").sortWithinPartitions(*order).select("part", "doc_id", "text", "tail")
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, doc_id, text, fingerprint) of the row before
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            for part, doc_id, text, tail in zip(*[c.to_pylist() for c in batch.columns]):
                if held is None or held[0] != part:
                    # Behind the first row of a tail there is nothing to compare.
                    if not tail:
                        held = (part, doc_id, text, Multiset(text))
                    continue
                now = Multiset(text)
                _, this_id, this, mine = held
                cut = len(this) // 3
                edited = this[: len(this) - cut] + text[:cut]
                changed = mine if edited == this else Multiset(edited)
                out.append((this_id, len(this), hashlib.sha256(edited.encode("utf-8")).hexdigest(), mine.hex(), changed.hex(), likeness(mine, changed), likeness(mine, now)))
                # Of a tail only the first row counts: it follows the last row of the range.
                held = None if tail else (part, doc_id, text, now)
            if len(out) > 500:
                yield packed()
                out = []
        if out:
            yield packed()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema)
