"""Jaccard join of documents on word shingles, by signature trees.

Words are runs of other than white space with A-Z lowered; a document's set has its distinct shingles of five words (of fewer
words: the whole sequence).  Two documents link when 100 * |x & y| >= percent * |x | y|.  All links between different
sets are found; the result gives them as connected components.

1. A profile of each document is written: its size, a bitmap of its set as wide as the set needs, and the smallest hashes of its
   set, those below 3/8 of the hash range ("low") and as many more as the prefix needs.  A prefix has
   |x| - ceil(percent * |x| / 100) + 1 elements: linked sets share an element of their prefixes in any common order.
   Documents with equal sets within a stretch of input name one of them.
2. Low elements are counted.  The common order takes the rarest first; those of ``FREQUENT`` documents or more count as equally
   frequent and those that aren't low come last; equals go by hash.  A document whose elements of its own fill its prefix has no
   partner; the others keep what is left of their prefix.  Elements that are frequent within a stretch are counted there and not
   dealt, so no element deals more than ``FREQUENT`` rows a stretch.
3. Documents that share a prefix element, joined through the smallest of them, form candidate groups (components).  In a group of
   more than a block of documents the documents of an element make a list, and bitmaps tell which pairs of a list may link: elements of
   which only one of two sets sets the bit bound from below how far the sets differ.  What may link stays together; a pair that links is
   in a list, so it does.  A list of more than ``LIST`` documents stays together as a whole.
4. A group comes to one task with its texts and is joined by a signature tree.  Groups that are larger than a block, by documents or
   by elements, are cut into blocks, each with the same 16 pivots, which connect what is alike across blocks.
5. In groups of several blocks, links may be left between components.  Wider bitmaps of their documents tell which pairs of different
   components may still link; those pairs, and only those, are compared by their texts: first the most alike, then what is left.

Nothing depends on a cap: the constants decide where work is done, not what is compared.

Defined results: null, empty and blank texts have an empty set, link with nothing and are their own component; rows with one
doc_id are one document for links (any of their sets may link it) and each get the row's size; a null doc_id never links and its
component is null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, signature_tree
from .components import components
from .words import word_hashes

PERCENT, WORDS = 75, 5
LOW = (3 << 63) // 8
FREQUENT, PIVOTS, BLOCK, BLOCK_ELEMENTS, STRETCH, LIST, PART_ROWS, FEW = 16, 16, 1024, 2_000_000, 2_000_000, 4096, 1_000_000, 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


def batch_sets(texts: pa.Array, k: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its set: sorted distinct hashes (63 bits) of its shingles.  Words and shingles of all texts are hashed at once."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts.fill_null("").to_pylist()]
    data = np.frombuffer(b"".join(raw), np.uint8)
    words, bounds = word_hashes(data, np.cumsum([len(t) for t in raw], dtype=np.int64))

    def folded(w: np.ndarray, k: int) -> np.ndarray:
        if len(w) < k:
            return np.empty(0, np.int64)
        s = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            s = (s ^ w[i : len(w) - k + 1 + i]) * _P
            s ^= s >> np.uint64(29)
        return ((s * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1)).astype(np.int64)

    whole = folded(words, k)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a <= k:
            yield folded(words[a:b], b - a) if b > a else np.empty(0, np.int64)
            continue
        s = np.sort(whole[a : b - k + 1])
        keep = np.empty(len(s), bool)
        keep[0] = True
        np.not_equal(s[1:], s[:-1], out=keep[1:])
        yield s if keep.all() else s[keep]


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """The set of one text."""
    return next(batch_sets(pa.array([text], pa.string()), k))


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def width(n: int) -> int:
    """Bits of the bitmap of a set of n elements."""
    return 1 << max(6, int(4 * n // 3).bit_length())


def bitmap(s: np.ndarray, times: int = 1) -> bytes:
    """The bits that the elements of a set hash to, little-endian."""
    bits = np.zeros(times * width(len(s)), bool)
    bits[s & (len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def profile(docs: DataFrame, percent: int) -> DataFrame:
    """Of docs (doc_id, text): (doc, n, a, p, copy_of, hashes, often, bits): size, low elements, prefix length, a document with the
    same set, the hashes to deal, low ones that are frequent here, and the bitmap.  Rows with a = -1 list what a stretch found to be
    frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc", "n", "a", "p", "copy_of", "hashes", "often", "bits")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        rows: list[list] = []
        first: dict[bytes, int] = {}
        size = 0

        def closed() -> Iterator[pa.RecordBatch]:
            dealt = [r[5][: r[2]] for r in rows if len(r[5])]
            often = np.empty(0, np.int64)
            if dealt:
                value = np.sort(np.concatenate(dealt))
                far = value[FREQUENT - 1 :] == value[: max(0, len(value) - FREQUENT + 1)]
                often = np.unique(value[FREQUENT - 1 :][far])
            if len(often):
                for r in rows:
                    if r[2] and len(r[5]):
                        is_often = np.isin(r[5], often, assume_unique=True, kind="sort")
                        r[6], r[5] = r[5][is_often], r[5][~is_often]
                rows.append([None, 0, -1, 0, None, often, (), None])
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 1000]), kinds)], names=names)

        for batch in batches:
            for doc, s in zip(batch.column(0).to_pylist(), batch_sets(batch.column(1))):
                n = len(s)
                a, p = int(np.searchsorted(s, LOW)), prefix(n, percent)
                copy_of = None
                if n and doc is not None:
                    key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    copy_of = first.setdefault(key, doc)
                if copy_of == doc:
                    copy_of = None
                alone = doc is None or copy_of is not None
                hashes = s[:0] if alone else s[: max(a, p)].copy()
                rows.append([doc, n, a, p, copy_of, hashes, (), None if alone or not n else bitmap(s)])
                size += len(hashes)
                if size >= STRETCH:
                    yield from closed()
                    rows, first, size = [], {}, 0
        if rows:
            yield from closed()

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), "doc long, n long, a long, p long, copy_of long, hashes array<long>, often array<long>, bits binary")


def prefixes(profiles: DataFrame) -> DataFrame:
    """(doc, n, alone, bits, elements): what is left of the prefixes of the documents that may have a partner, and the share of their
    low elements that no other document has."""
    dealt = profiles.where("size(hashes) > 0").select("doc", F.explode("hashes").alias("h"))
    of = Window.partitionBy("h")
    seen = dealt.withColumn("k", F.count(F.lit(1)).over(of)).withColumn("marks", F.sum(F.col("doc").isNull().cast("int")).over(of))
    often = (F.col("k") >= FREQUENT) | (F.col("marks") > 0)
    level = F.when(F.col("h") >= LOW, FREQUENT + 1).when(often, FREQUENT).otherwise(F.col("k")).cast("int")
    shared = seen.where("k > 1 AND doc IS NOT NULL").select("doc", F.struct(level.alias("level"), "h").alias("e"))
    shared = shared.groupBy(F.col("doc").alias("of")).agg(F.collect_list("e").alias("shared"))
    own = profiles.where("a >= 0 AND doc IS NOT NULL AND copy_of IS NULL AND n > 0").select("doc", "n", "a", "p", "often", "bits")
    both = own.join(shared, F.col("doc") == F.col("of"), "left")
    both = both.withColumn("shared", F.coalesce("shared", F.array().cast("array<struct<level:int,h:bigint>>")))
    low = F.size(F.filter("shared", lambda e: e["level"] <= FREQUENT))
    own_elements = F.col("a") - F.size("often") - low
    left = F.col("p") - own_elements
    often = F.transform("often", lambda h: F.struct(F.lit(FREQUENT).alias("level"), h.alias("h")))
    kept = F.slice(F.array_sort(F.concat("shared", often)), F.lit(1), F.greatest(left, F.lit(0)).cast("int"))
    alone = own_elements / F.greatest(F.col("a"), F.lit(1))
    return both.withColumn("kept", kept).where(left > 0).select("doc", "n", alone.alias("alone"), "bits", F.transform("kept", lambda e: e["h"]).alias("elements"))


def _folded(bits: bytes, w: int) -> np.ndarray:
    """A bitmap of w bits as 64-bit numbers; a wider one is folded."""
    x = np.frombuffer(bits, "<u8")
    return x if 64 * len(x) == w else np.bitwise_or.reduce(x.reshape(-1, w // 64), axis=0)


def _near(n: np.ndarray, rows: np.ndarray, m: int, row: np.ndarray, percent: int) -> np.ndarray:
    """Which sets (sizes n, bitmaps rows) may link with one set, as far as sizes and bitmaps tell: an element that one set alone has
    sets at most one bit that differs, and linked sets differ in (100 - percent) / (100 + percent) of their sizes at most."""
    differ = np.bitwise_count(rows ^ row).sum(axis=1, dtype=np.int64)
    return (differ * (100 + percent) <= (100 - percent) * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _may_link(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    if 100 * min(n, m) < percent * max(n, m):
        return False
    w = 8 * min(len(x), len(y))
    p, q = (int.from_bytes(z if 8 * len(z) == w else _folded(z, w).tobytes(), "little") for z in (x, y))
    return (p ^ q).bit_count() * (100 + percent) <= (100 - percent) * (n + m)


def _classes(sizes: list[int], percent: int) -> list[tuple[int, list[int]]]:
    """(w, places): the widths of bitmaps, each with the sets of that width and of wider ones that still may link with them."""
    widths = [width(n) for n in sizes]
    most = max(1, -(-100 // percent)) * 2
    return [(w, [i for i, x in enumerate(widths) if w <= x <= most * w]) for w in sorted(set(widths))]


def _edges(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["a", "b"])


def shared_edges(left: DataFrame) -> DataFrame:
    """(a, b): documents of left that share an element, each with the smallest that has it."""
    rows = left.select("doc", F.explode("elements").alias("h"))
    least = rows.groupBy("h").agg(F.min("doc").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1").select(common.skew_key("h").alias("same"), "b")
    return rows.join(least, F.col("h").cast("string") == F.col("same")).where("doc <> b").select(F.col("doc").alias("a"), "b").distinct()


def list_edges(large: DataFrame, percent: int, most: int = LIST) -> DataFrame:
    """(a, b): stars that connect the documents of a group of large (doc, grp, part, n, bits, elements) which share an element and may
    link.  A group's elements stand in parts of bounded size, and a part is worked on alone.  A list of more than ``most`` documents
    connects all it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, docs, sizes, bits, elements = None, [], [], [], []

        def joined() -> Iterator[pa.RecordBatch]:
            groups = signature_tree.Groups(len(docs))
            which = np.repeat(np.arange(len(docs)), [len(e) for e in elements])
            h = np.concatenate(elements)
            order = np.argsort(h, kind="stable")
            h, which = h[order], which[order]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(h)).tolist()):
                own = which[a:b].tolist()
                if len(own) < 2:
                    continue
                roots = [groups.find(i) for i in own]
                if roots.count(roots[0]) == len(roots):
                    continue
                if len(own) > most:
                    for i in own[1:]:
                        groups.join(own[0], i)
                elif len(own) <= 8:
                    for k, i in enumerate(own):
                        for j in own[k + 1 :]:
                            if groups.find(i) != groups.find(j) and _may_link(sizes[i], bits[i], sizes[j], bits[j], percent):
                                groups.join(i, j)
                else:
                    for w, members in _classes([sizes[i] for i in own], percent):
                        members = [own[k] for k in members]
                        n = np.array([sizes[i] for i in members], np.int64)
                        rows = np.stack([_folded(bits[i], w) for i in members])
                        rest = np.arange(len(members))
                        while len(rest):
                            open_, rest = [rest[0]], rest[1:]
                            while open_ and len(rest):
                                i = open_.pop()
                                near = _near(n[rest], rows[rest], int(n[i]), rows[i], percent)
                                for j in rest[near]:
                                    groups.join(members[i], members[j])
                                open_.extend(rest[near])
                                rest = rest[~near]
            out = [(d, docs[r]) for i, d in enumerate(docs) if (r := groups.find(i)) != i]
            if out:
                yield _edges(out)

        for batch in batches:
            for doc, grp, part, n, x, own in zip(*[c.to_pylist() for c in batch.columns[:5]], (np.array(v.values) for v in batch.column(5))):
                if (grp, part) != at:
                    if docs:
                        yield from joined()
                    at, docs, sizes, bits, elements = (grp, part), [], [], [], []
                docs.append(doc)
                sizes.append(n)
                bits.append(x)
                elements.append(own)
        if docs:
            yield from joined()

    rows = large.select("doc", "grp", "part", "n", "bits", "elements").where(F.size("elements") > 0)
    rows = rows.repartition(common.partitions(large.sparkSession), "grp", "part").sortWithinPartitions("grp", "part", "doc")
    return rows.mapInArrow(common.lean(run), "a long, b long")


def told_apart(groups: DataFrame, left: DataFrame, percent: int, block: int, scratch: common.Scratch, most: int = LIST) -> DataFrame:
    """groups (node, label) with those of more than a block of documents as the groups that lists and bitmaps make of them."""
    sizes = groups.join(left.select(F.col("doc").alias("of"), F.size("elements").alias("rows")), F.col("node") == F.col("of"))
    sizes = sizes.groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.sum("rows").alias("rows")).where(F.col("k") > block)
    sizes = scratch.written(sizes.select(common.skew_key("label").alias("large"), F.ceil(F.col("rows") / PART_ROWS).cast("int").alias("parts")), "large")
    if sizes.isEmpty():
        return groups
    large = F.col("label").cast("string") == F.col("large")
    members = scratch.written(groups.join(sizes, large).select(F.col("node").alias("of"), F.col("label").alias("grp"), "parts"), "large-members")
    rows = left.join(members, F.col("doc") == F.col("of")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("elements", F.when(F.col("parts") == 1, F.col("elements")).otherwise(F.filter("elements", lambda h: F.pmod(h, F.col("parts")) == F.col("part"))))
    again = components(scratch.written(list_edges(rows, percent, most), "edges"), scratch)
    return scratch.written(groups.join(sizes, large, "left_anti").unionByName(again), "groups")


def _blocks(groups: DataFrame, block: int, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """Of groups (doc, grp, n, alone): (doc, grp, block) of all members and, for groups of several blocks, their pivots in every block;
    and (doc, grp, parts) of those groups.

    Pivots are documents with few elements of their own: copies that were changed each in another way are alike to what they were
    made from more than to each other."""
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("elements"))
    blocks = F.ceil(F.greatest(F.col("k") / block, F.col("elements") / BLOCK_ELEMENTS)).cast("int")
    sizes = sizes.select(common.skew_key("grp").alias("same"), blocks.alias("blocks"), F.ceil(F.greatest(F.col("k") / LIST, F.col("elements") / (4 * BLOCK_ELEMENTS))).cast("int").alias("parts"))
    members = scratch.written(groups.join(sizes, F.col("grp").cast("string") == F.col("same")).select("doc", "grp", "alone", "blocks", "parts"), "members")
    large, place = members.where("blocks > 1"), F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    pivots = large.groupBy("grp", "blocks", F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(PIVOTS)).alias("r")).agg(F.min_by("doc", F.struct("alone", F.xxhash64("doc", F.lit(2)))).alias("doc"))
    pivots = pivots.select("doc", "grp", place.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).where("block <> own")
    return members.select("doc", "grp", place.alias("block")).unionByName(pivots.drop("own")), large.select("doc", "grp", "parts")


def _texts(asked: DataFrame, docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """asked (a written table) with the texts of its column doc.  Up to ``FEW`` rows of it go to where the texts are (some tens of MB);
    more meet them by the join alone."""
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("of"), F.col("text").alias(text))
    few = asked.count() <= FEW
    return texts.join(F.broadcast(asked) if few else asked, F.col(doc) == F.col("of")).drop("of")


def _join_blocks(rows: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links within each (grp, block) of rows (doc, grp, block), as edges to one document a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        docs: list[int] = []
        sets: list[np.ndarray] = []
        out: list[tuple[int, int]] = []

        def settle() -> None:
            groups = signature_tree.Groups(len(sets))
            same: dict[int, int] = {}
            for i, d in enumerate(docs):
                groups.join(same.setdefault(d, i), i)
            signature_tree.self_join(sets, groups, percent)
            for i, d in enumerate(docs):
                r = docs[groups.find(i)]
                if r != d:
                    out.append((d, r))

        for batch in batches:
            keys = zip(*[batch.column(k).to_pylist() for k in range(3)])
            for (doc, grp, block), s in zip(keys, batch_sets(batch.column(3))):
                if at != (grp, block):
                    settle()
                    at, docs, sets = (grp, block), [], []
                docs.append(doc)
                sets.append(s)
            if len(out) > 5000:
                yield _edges(out)
                out.clear()
        settle()
        if out:
            yield _edges(out)

    rows = _texts(rows, docs).select("doc", "grp", "block", "text")
    rows = rows.repartition(common.partitions(docs.sparkSession), "grp", "block").sortWithinPartitions("grp", "block", "doc")
    return rows.mapInArrow(common.lean(run), "a long, b long")


def _wide(several: DataFrame, docs: DataFrame) -> DataFrame:
    """several (doc, grp, parts) with n and a bitmap of eight times the usual width: near misses of a group of copies show in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(batch_sets(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(map(len, sets), pa.int64()), pa.array([bitmap(s, 8) for s in sets], pa.binary())], names=["doc", "grp", "parts", "n", "bits"])

    return _texts(several, docs).select("doc", "grp", "parts", "text").mapInArrow(common.lean(run), "doc long, grp long, parts int, n long, bits binary")


def open_pairs(wide: DataFrame, labels: DataFrame, percent: int, scratch: common.Scratch, best: bool) -> DataFrame | None:
    """(a, b): the pairs of documents of one group of wide but of different components of labels (node, label) that may still link; null
    if no group has several components.  best: of each document and each other component only the pair that is most alike.

    The documents outside a group's largest component look at all of its documents, whose bitmaps stand in parts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base, classes = None, [], None
        found: set[tuple[int, int]] = set()
        for batch in batches:
            for grp, part, role, doc, n, bits, label in zip(*[c.to_pylist() for c in batch.columns]):
                if (grp, part) != at:
                    at, base, classes = (grp, part), [], None
                if not role:
                    base.append((doc, n, bits, label))
                    continue
                if classes is None:  # those that look come behind those that are looked at
                    classes = []
                    for w in sorted({8 * len(r[2]) for r in base}):
                        own = [r for r in base if 8 * len(r[2]) == w]
                        classes.append((w, np.stack([_folded(r[2], w) for r in own]), *(np.array([r[k] for r in own], np.int64) for k in (0, 1, 3))))
                for w, rows, docs, sizes, labels in classes:
                    mine = 8 * len(bits)
                    if max(w, mine) > 4 * min(w, mine) and 100 * min(n, int(sizes.max())) < percent * max(n, int(sizes.min())):
                        continue
                    v = min(w, mine)
                    rows = rows if v == w else np.bitwise_or.reduce(rows.reshape(len(rows), -1, v // 64), axis=1)
                    differ = np.bitwise_count(rows ^ _folded(bits, v)).sum(axis=1, dtype=np.int64)
                    near = (differ * (100 + percent) <= (100 - percent) * (sizes + n)) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)) & (labels != label)
                    hits = np.flatnonzero(near)
                    if best and len(hits):
                        hits = hits[np.argsort(differ[hits], kind="stable")]
                        hits = hits[np.unique(labels[hits], return_index=True)[1]]
                    found.update((min(doc, x), max(doc, x)) for x in docs[hits].tolist())
                if len(found) > 50_000:
                    yield _edges(found)
                    found.clear()
        if found:
            yield _edges(found)

    state = wide.join(labels, F.col("doc") == F.col("node"), "left").select("doc", "grp", "parts", "n", "bits", F.coalesce("label", "doc").alias("label"))
    state = scratch.written(state, "state")
    main = state.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("grp").agg(F.max(F.struct("k", "label")).alias("m"), F.count(F.lit(1)).alias("labels"))
    main = scratch.written(main.where("labels > 1").select(common.skew_key("grp").alias("same"), F.col("m.label").alias("main")), "main")
    if main.isEmpty():
        return None
    rows = state.join(main, F.col("grp").cast("string") == F.col("same"))
    what = ["doc", "n", "bits", "label"]
    base = rows.select("grp", F.pmod(F.xxhash64("doc", F.lit(3)), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("role"), *what)
    look = rows.where("label <> main").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), *what)
    both = base.unionByName(look).repartition(common.partitions(wide.sparkSession), "grp", "part").sortWithinPartitions("grp", "part", "role")
    return scratch.written(both.mapInArrow(common.lean(run), "a long, b long").distinct(), "open-pairs")


def _compared(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch_sets(batch.column(2)), batch_sets(batch.column(3)))
            yield batch.select([0, 1]).filter(pa.array([signature_tree.linked(x, y, percent) for x, y in sets], pa.bool_()))

    first = _texts(pairs, docs, "a", "text_a")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("of"), F.col("text").alias("text_b"))
    wanted = pairs.select(F.col("b").alias("wanted")).distinct()
    if pairs.count() <= FEW:
        texts = texts.join(F.broadcast(wanted), F.col("of") == F.col("wanted"), "left_semi")
    rows = first.join(texts, F.col("b") == F.col("of"))
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(common.lean(run), "a long, b long")


def near_components(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, most: int = LIST) -> tuple[DataFrame, DataFrame]:
    """(doc, n) of all rows, and (node, label) of the documents that link with another: label is the smallest doc_id."""
    spark = common.prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    with common.Scratch(spark) as scratch:
        profiles = scratch.written(profile(docs, percent), "profiles")
        left = scratch.written(prefixes(profiles), "prefixes")
        sizes = common.written(profiles.where("a >= 0").select("doc", "n"), "sizes")
        copies = scratch.written(profiles.where("copy_of IS NOT NULL").select(F.col("doc").alias("a"), F.col("copy_of").alias("b")), "copies")
        scratch.done(profiles)
        groups = told_apart(components(shared_edges(left), scratch), left, percent, block, scratch, most)
        n = left.groupBy(F.col("doc").alias("of")).agg(F.max("n").alias("n"), F.min("alone").alias("alone"))
        groups = groups.join(n, F.col("node") == F.col("of")).select(F.col("node").alias("doc"), F.col("label").alias("grp"), "n", "alone")
        rows, several = _blocks(scratch.written(groups, "groups"), block, scratch)
        links = scratch.written(_join_blocks(scratch.written(rows, "blocks"), docs, percent), "links")
        found = components(links.unionByName(copies), scratch)
        if not several.isEmpty():
            wide = scratch.written(_wide(several, docs), "wide")
            # The most alike pairs first: what they join needn't be told apart pair by pair.
            for best in (True, False):
                if (pairs := open_pairs(wide, found, percent, scratch, best)) is None:
                    break
                late = scratch.written(_compared(pairs, docs, percent), "late-links")
                found = components(found.toDF("a", "b").unionByName(late), scratch)
        return sizes, common.written(found, "components")


def component_of(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    sizes, found = near_components(docs, percent)
    rows = sizes.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"))
    return rows.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component of docs, one with the smallest doc_id, and all rows that link with nothing.  Of several rows of one
    doc_id and text, if that has words, the one with the smallest hash of its columns stays."""
    sizes, found = near_components(docs, percent)
    gone = found.where("label <> node").select(F.col("node").alias("near_copy_of_another"))
    rows = docs.join(gone, docs["doc_id"] == gone["near_copy_of_another"], "left_anti")
    twice = sizes.where("n > 0 AND doc IS NOT NULL").groupBy("doc").count().where("count > 1").select(F.col("doc").alias("repeated_doc_id"))
    twice = common.written(twice, "repeated")
    if twice.isEmpty():
        return rows
    same = docs["doc_id"] == twice["repeated_doc_id"]
    has_words = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    row = F.struct(*docs.columns)
    again = rows.join(twice, same, "left_semi")
    one = again.where(has_words).groupBy("doc_id", F.md5(F.col("text").cast("binary"))).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return rows.join(twice, same, "left_anti").unionByName(one).unionByName(again.where(~has_words))
