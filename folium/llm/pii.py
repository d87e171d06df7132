"""Personal data: base patterns, and information-theoretic sanitisation of the terms that reveal them.

Base spans (code points, end exclusive) are e-mail addresses, IPv4 addresses, payment cards and phone numbers by the patterns
below.  Their values are the protected entities.  The corpus tells how strongly a term t reveals an entity e: with
p(e), p(t) and p(e, t) the shares of documents that hold e, hold t, and hold both (t outside of base spans, at any distance),
the disclosure of e by t is PMI(e; t) / IC(e), where PMI(e; t) = ln p(e, t) / (p(e) p(t)) and IC(e) = -ln p(e).  A term is
removed if its disclosure of any entity reaches ``REMOVE``, and generalised (to the class of its shape) from ``GENERALISE`` on, if
more than ``MAJORITY`` of the documents that hold it hold the entity: at each of its places outside of base spans, in documents that don't
hold the entity as well.  (Disclosure alone is 1 - ln(1 / p(e | t)) / IC(e), which in a large corpus is near 1 for all that a rare
entity was ever seen with, be it in one document of twenty; such a term says nothing about who is meant.)  Entities and terms of a single
document are judged like all others: p(t) is smoothed by one document (``SMOOTH``) that holds t without e, so a term that only
ever stands with e comes near 1 the more documents say so.

All documents are counted; a row counts as a document.  What is found is a function of a text and the corpus, so rows are
matched by the MD5 of their texts.

Defined results: null text is empty and has no spans; base spans of different kinds may overlap and all stay; sanitised text
replaces overlapping spans together, by the label of the first; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
SMOOTH, GENERALISE, REMOVE, MAJORITY = 1, 0.85, 0.95, 0.5
FLUSH, MARKS = 200_000, 25

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Digit runs are tried from their first digit only and never given back, so long ones take linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"\w+")
_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, sought from each @ outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans of a text, in order."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


def entity(text: str, kind: int) -> int:
    value = text.lower() if kind == 0 else text if kind == 1 else re.sub(r"[^0-9]", "", text)
    return _hash(f"{kind}|{value}")


def _terms(text: str, spans: list[tuple[int, int, int]], among: frozenset[str] | None = None) -> Iterator[re.Match[str]]:
    """The terms of a text outside of all spans, only those ``among`` the given ones if there are any given."""
    starts, reach = [a for a, _, _ in spans], list(itertools.accumulate((b for _, _, b in spans), max))
    for m in _TERM.finditer(text):
        if among is None or m[0] in among:
            k = bisect.bisect_left(starts, m.end())
            if not k or reach[k - 1] <= m.start():
                yield m


def scan(docs: DataFrame) -> DataFrame:
    """The base result of every row of docs (doc_id, text), with its spans, entities and, where it has any, its other terms."""
    common.prepare(docs.sparkSession)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
             pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ("doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                spans = base_spans(text)
                n = Counter(k for _, k, _ in spans)
                terms = {_hash(w) for w in {m[0].lower() for m in _terms(text, spans)}} if spans else ()
                rows.append((doc_id, hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest(), n[0], n[1], n[2], n[3], hashlib.sha256(joined(spans).encode()).hexdigest(),
                             [dict(start=a, kind=k, end=b) for a, k, b in spans], list({entity(text[a:b], k) for a, k, b in spans}), list(terms)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    schema = ("doc_id long, key string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, "
              "entities array<long>, terms array<long>")  # fmt: skip
    return docs.select("doc_id", "text").mapInArrow(common.lean(run), schema)


def term_counts(docs: DataFrame) -> DataFrame:
    """(t, n): the number of documents that hold each term.  Tasks add up what they have read before it is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()

        def packed() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pydict({"t": pa.array(map(_hash, count.keys()), pa.int64()), "n": pa.array(count.values(), pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                count.update({w.lower() for w in set(_TERM.findall(text or ""))})
            if len(count) > FLUSH:
                yield from packed()
                count.clear()
        if count:
            yield from packed()

    return docs.select("text").mapInArrow(common.lean(run), "t long, n long").groupBy("t").agg(F.sum("n").alias("n_t"))


def disclosures(docs: DataFrame, found: DataFrame, smooth: int = SMOOTH, generalise: float = GENERALISE, remove: float = REMOVE, majority: float = MAJORITY) -> DataFrame:
    """(e, t, kind): terms whose disclosure of an entity reaches the thresholds; kind is a place in KINDS."""
    n = found.count()
    each = found.where("size(entities) > 0").select(F.explode("entities").alias("e"), "terms").select("e", F.explode("terms").alias("t"))
    pairs = each.groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_et"))
    pairs = common.written(pairs, "pairs")
    entities = found.select(F.explode("entities").alias("of")).groupBy("of").agg(F.count(F.lit(1)).alias("n_e"))
    pairs = pairs.join(entities.select(common.skew_key("of").alias("of"), "n_e"), F.col("e").cast("string") == F.col("of")).drop("of")
    terms = term_counts(docs)
    pairs = pairs.join(terms.select(common.skew_key("t").alias("term"), "n_t"), F.col("t").cast("string") == F.col("term"))
    # n_t counts terms inside of base spans too, so n_et <= n_t.
    ic = F.log(F.lit(float(max(n, 1))) / F.col("n_e"))
    pmi = F.log(F.col("n_et").cast("double") * (n + smooth) / (F.col("n_e") * (F.col("n_t") + smooth)))
    share = F.when(ic > 0, pmi / ic)
    kind = F.when(share >= remove, KINDS.index("removed")).when(share >= generalise, KINDS.index("generalised"))
    most = F.col("n_et") > majority * F.col("n_t")
    return pairs.where(most).select("e", "t", kind.alias("kind")).where("kind IS NOT NULL")


def _marked(terms: DataFrame) -> bytes:
    """A table of 2^MARKS bits with the low bits of each t set: it never grows, and what it lets through is joined after."""
    low = F.col("t").bitwiseAND((1 << MARKS) - 1)
    sets = terms.select(F.shiftright(low, 15).alias("at"), low.bitwiseAND(32767).alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = bytearray(1 << (MARKS - 3))
    for row in sets.collect():
        bits[row["at"] << 12 : (row["at"] + 1) << 12] = row["bits"]
    return bytes(bits)


def term_spans(docs: DataFrame, disclosed: DataFrame) -> DataFrame:
    """(key, terms): for each text, by its MD5, the spans of the terms to generalise or remove, wherever they stand."""
    terms = common.written(disclosed.groupBy("t").agg(F.max("kind").cast("int").alias("kind")), "terms")
    bits = docs.sparkSession.sparkContext.broadcast(_marked(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, memo = bits.value, {}

        def hit(word: str) -> bool:
            if word not in memo:
                low = _hash(word.lower()) & ((1 << MARKS) - 1)
                memo[word] = bool(marked[low >> 3] >> (low & 7) & 1)
            return memo[word]

        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if words := frozenset(filter(hit, set(_TERM.findall(text or "")))):
                    key = hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()
                    rows += [(key, _hash(m[0].lower()), m.start(), m.end()) for m in _terms(text, base_spans(text), words)]
                if len(memo) > FLUSH:
                    memo.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.int32()))], names=["key", "t", "start", "end"])

    rows = common.written(docs.select("text").mapInArrow(common.lean(run), "key string, t long, start int, end int").distinct(), "places")
    hit = rows.join(terms.select(common.skew_key("t").alias("term"), "kind"), F.col("t").cast("string") == F.col("term"))
    return hit.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("terms"))


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = common.written(scan(docs), "pii-scan")
    return found, common.written(term_spans(docs, disclosures(docs, found)), "pii-terms")


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every row of docs."""
    docs = docs.select("doc_id", "text")
    found, terms = _found(docs)
    rows = found.select("doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base").join(terms.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(_SPAN))))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"))


def general(term: str) -> str:
    """The class that stands for a generalised term, by its shape."""
    return "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[TERM]"


def sanitised(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]" if kind < 4 else general(text[a:b]) if KINDS[kind] == "generalised" else ""]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data and revealing terms taken out of ``text``; columns and rows stay as they are."""
    names = docs.columns
    _, terms = _found(docs.select("doc_id", "text"))
    column = "revealing_terms"
    while column in names:
        column += "_"
    terms = terms.select(F.col("key").alias(f"{column}_key"), F.col("terms").alias(column))
    rows = docs.join(terms, F.md5(common.text_or_empty().cast("binary")) == F.col(f"{column}_key"), "left").drop(f"{column}_key")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else sanitised(t, base_spans(t) + [(x["start"], x["kind"], x["end"]) for x in more or ()]) for t, more in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(common.lean(run), docs.schema)
