"""Main text of web pages: declared regions by markup, the rest by a host suffix array.

A page is cut into blocks.  Markup puts a block inside an article (``article``, ``main``), inside a declared region of
another kind (menus, headers, footers, sidebars, notices, adverts, forms, comments: by element, role, class and id), or leaves it
open.  The blocks of the article are the candidates for the main text where there is one, the open blocks where there is none.  What
the pages of a host repeat judges all candidates, with what markup says as a prior:

* Each page has two token streams, that of its articles and that of all its other blocks.  The streams of a host are
  concatenated and their suffixes sorted by prefix doubling up to ``RUN`` tokens.  Suffixes that are equal to that depth begin
  a repeated substring of that length or more, and the substrings of ``RUN`` tokens cover the same tokens as all longer ones.
* A token outside articles is removed if a run that covers it stands in a tenth of the host's distinct streams, and in two of them
  at least.  Passages that articles share are often content, so a token in an article is removed only if such a run stands in more
  than half of the host's distinct articles, and in ``COMMON`` of them at least.
* What a page keeps are its unique runs, however much is covered.  Where fewer than ``RUN`` tokens would be left, the page repeats
  another as a whole (a copy, or a near copy) and stays as it is.
* Streams are dealt by host, large hosts by salt as well, equal streams together, so that they count once.  A run in a share of
  all streams of a host is in that share of some sorted stretch, so only runs that have it there are named.  Runs whose number is
  still open, as stretches don't name what is below their share, are counted once more, exactly.

Pages are parsed where they are read, in two or three passes; nothing but streams is dealt.  The runs to remove are broadcast, some
hundred thousand at a time: beyond that, pages are taken in rounds by host.

Blocks end at block elements and ``br``.  Character references are decoded, white space in a block becomes one space, blocks are
joined by a line feed.

Defined results: null html is empty; a page without text gives an empty string; pages with a null url share one host; rows equal in
all columns each get the same text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .words import word_hashes

#: Tokens of a run (a power of two), tokens sorted at once, distinct articles from which a run in them can be boilerplate, streams of a
#: host from which it is salted, runs of a round.
RUN, STRETCH, COMMON, SALTED, ROUND = 8, 1 << 20, 5, 2000, 500_000
_HOSTS = 1 << 16

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_CLOSES_P = _BLOCK - frozenset("br body html head title option optgroup td th tr tbody thead tfoot".split())
_RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math object audio video canvas select".split())
_OTHER = frozenset("nav header footer aside form menu dialog button label fieldset search head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promotions sidebar sidebars rail nav navbar navigation menu menus submenu breadcrumb breadcrumbs "
    "header masthead footer colophon cookie cookies consent gdpr notice notices notification popup modal overlay lightbox newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus reply replies respond widget widgets toolbar pagination pager skip copyright legal disclaimer".split()
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in _RAW}
_PART_OF = frozenset("article entry post story content".split())

_ABOUT = frozenset("has with no without is hide show".split())

MAIN, OTHER, OPEN = 0, 1, 2


def _declared(tag: str, attributes: str) -> int | None:
    """MAIN or OTHER if an element says which it is."""
    if tag in _OTHER:
        return OTHER
    found = None
    if attributes:
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        role = values.get("role", "").lower()
        if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").replace(" ", "").lower() or role in _ROLES:
            return OTHER
        if tag not in ("body", "html", "main", "h1"):
            for name in f"{values.get('class', '')} {values.get('id', '')}".split():
                words = [w.lower() for w in _WORD.findall(name)] or [""]
                if any(w in _NAMES for w in (*words, *name.lower().replace("_", "-").split("-"))) and words[0] not in _ABOUT and not (words[0] in _PART_OF and words[-1] in ("header", "notice")):
                    return OTHER
        if role in ("main", "article"):
            found = MAIN
    return MAIN if tag in ("article", "main") else found


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page that have text, in order."""
    found: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    kind = OPEN
    unclosed: set[str] = set()  # raw elements without a further end tag
    quotes = {'"': True, "'": True}  # whether any is left to be found

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                found.append((kind, text))
            held.clear()

    def pop(to: int) -> None:
        nonlocal kind
        for tag, _ in stack[to:]:
            opened[tag] -= 1
        del stack[to:]
        kind = stack[-1][1] if stack else OPEN

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            held.append(page[at:])
            break
        if lt > at:
            held.append(page[at:lt])
        after = page[lt + 1 : lt + 2]
        closing = after == "/"
        if closing:
            after = page[lt + 2 : lt + 3]
        if not (after.isascii() and after.isalpha()):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            elif after in ("!", "?") or closing:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                held.append("<")
                at = lt + 1
            continue
        end = page.find(">", lt)
        if end < 0:
            break
        # A ">" inside a quoted value doesn't end the tag.
        mark = lt + 1
        while True:
            quote = min((q for q in (page.find('"', mark, end), page.find("'", mark, end)) if q >= 0), default=-1)
            if quote < 0:
                break
            sign = page[quote]
            shut = page.find(sign, quote + 1) if quotes[sign] else -1
            if shut < 0:
                quotes[sign] = False
                break
            mark = shut + 1
            if shut > end:
                end = page.find(">", shut)
                if end < 0:
                    end = page.find(">", lt)
                    break
        inside = page[lt + 1 + closing : end]
        at = end + 1
        name = re.match(r"[^\s/>]+", inside)[0]
        tag = name.lower()
        if tag in _BLOCK:
            flush()
        if closing:
            if opened[tag]:
                to = len(stack) - 1
                while stack[to][0] != tag:
                    to -= 1
                if kind != (stack[to - 1][1] if to else OPEN):
                    flush()
                pop(to)
            continue
        if tag in _RAW:
            if not inside.endswith("/"):
                m = _CLOSING[tag].search(page, at) if tag not in unclosed else None
                if m is None:
                    unclosed.add(tag)
                shut = page.find(">", m.end()) if m else -1
                at = size if m is None and tag in ("script", "style", "template", "textarea", "title", "xmp") else at if m is None else size if shut < 0 else shut + 1
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES_P and opened["p"] or tag == "li" and opened["li"]:
            want, stop = ("li", ("ul", "ol", "menu")) if tag == "li" else ("p", _CLOSES_P)
            to = len(stack) - 1
            while to >= 0 and stack[to][0] != want and stack[to][0] not in stop:
                to -= 1
            if to >= 0 and stack[to][0] == want:
                pop(to)
        says = OTHER if kind == OTHER else _declared(tag, inside[len(name) :])
        new = kind if says is None else says
        if new != kind:
            flush()
        stack.append((tag, new))
        opened[tag] += 1
        kind = new
    flush()
    return found


def equal_suffixes(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): the suffixes of tokens sorted to the given depth (a power of two), and each suffix's rank; suffixes with
    one rank are equal to that depth.  Token -1 - i ends a page, so no run reaches over it."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step, n = 1, len(tokens)
    while step < depth:
        following = np.full(n, -1, np.int64)
        following[: max(0, n - step)] = rank[step:]
        rank = np.unique(rank * (n + 1) + following + 1, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return np.argsort(rank, kind="stable"), rank


def _tokens(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    return (word_hashes(np.frombuffer(raw, np.uint8), np.array([len(raw)]))[0] >> np.uint64(1)).astype(np.int64)


def prefixes(tokens: np.ndarray) -> np.ndarray:
    """A hash of the RUN tokens from each place on."""
    n = len(tokens) - RUN + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(RUN):
        h = (h ^ tokens[i : n + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(1)).astype(np.int64)


ARTICLE, OUTSIDE = 0, 1


def need(part: int, n: int) -> int:
    """In how many of n distinct streams a run is boilerplate."""
    return max(COMMON, n // 2 + 1) if part == ARTICLE else max(2, -(-n // 10))


def _below(part: int, n: int) -> int:
    """In how many of a stretch's n streams a run may be without being named."""
    return n // 2 if part == ARTICLE else -(-n // 10) - 1


def _host() -> Column:
    return F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("?"))


def _parts(page: str | None) -> tuple[list[str], list[str], str]:
    """The article's blocks, the open blocks, and the text of all blocks outside of articles."""
    found = blocks(page or "")
    return [t for k, t in found if k == MAIN], [t for k, t in found if k == OPEN], " ".join([t for k, t in found if k != MAIN])


def _salts(pages: DataFrame) -> np.ndarray:
    """How many salts a host takes, by its bucket: a table of fixed size.  A small host in the bucket of a large one is salted too."""
    sizes = pages.groupBy(_host().alias("host")).count().groupBy(F.pmod(F.xxhash64("host"), F.lit(_HOSTS)).cast("int").alias("bucket")).agg(F.max("count").alias("n"))
    salts = np.ones(_HOSTS, np.int64)
    for bucket, n in sizes.where(F.col("n") > SALTED).collect():
        salts[bucket] = 1 << int(np.ceil(np.log2(n / SALTED)))
    return salts


def streams(pages: DataFrame) -> DataFrame:
    """(host, part, salt, copy, text): the streams of all pages, dealt by host and salt; equal ones stand together."""
    salts = _salts(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string())
        for batch in batches:
            rows = []
            for host, bucket, page in zip(*[c.to_pylist() for c in batch.columns]):
                main, _, outside = _parts(page)
                for part, text in ((ARTICLE, "\n".join(main)), (OUTSIDE, outside)):
                    if text:
                        copy = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1
                        if (host, part, copy) not in seen:
                            seen.add((host, part, copy))
                            rows.append((host, part, copy % int(salts[bucket]), copy, text))
            if len(seen) > 100_000:
                seen.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["host", "part", "salt", "copy", "text"])

    bucket = F.pmod(F.xxhash64("host"), F.lit(_HOSTS)).cast("int").alias("bucket")
    found = pages.select(_host().alias("host"), "html").select("host", bucket, "html").mapInArrow(run, "host string, part int, salt int, copy long, text string")
    return found.repartition(common.partitions(pages.sparkSession), "host", "part", "salt").sortWithinPartitions("host", "part", "salt", "copy")


def named_runs(found: DataFrame) -> DataFrame:
    """(host, part, prefix, n, below): for each stretch of a host's streams the runs that have its share, with the number of streams that
    have them; and a row of prefix -1 with the number of all streams.  below is what the stretch may hide of a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, last = None, [], 0, None

        def named() -> pa.RecordBatch:
            host, part, _ = at
            stream = np.concatenate([np.append(t, -1 - i) for i, t in enumerate(held)])
            page = np.repeat(np.arange(len(held)), [len(t) + 1 for t in held])
            hashes = np.concatenate([np.append(h, np.full(len(t) + 1 - len(h), -1, np.int64)) for t in held for h in [prefixes(t)]])
            order, rank = equal_suffixes(stream, RUN)
            order = order[hashes[order] >= 0]
            least = _below(part, len(held))
            names, counts = np.empty(0, np.int64), np.empty(0, np.int64)
            if len(order):
                new = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
                # Suffixes of equal rank keep their order, so a page's own stand side by side.
                first = new | np.concatenate(([True], page[order][1:] != page[order][:-1]))
                starts = np.flatnonzero(new)
                counts = np.add.reduceat(first.astype(np.int64), starts)
                names, counts = hashes[order[starts]][counts > least], counts[counts > least]
            n = len(names) + 1
            columns = ([host] * n, [part] * n, np.append(names, -1), np.append(counts, len(held)), np.full(n, least))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "part", "prefix", "n", "below"])

        for batch in batches:
            for host, part, salt, copy, text in zip(*[c.to_pylist() for c in batch.columns]):
                if (host, part, salt) != at or size > STRETCH:
                    if held:
                        yield named()
                    if (host, part, salt) != at:
                        last = None
                    at, held, size = (host, part, salt), [], 0
                if copy != last:
                    held.append(_tokens(text))
                    size += len(held[-1])
                    last = copy
        if held:
            yield named()

    return found.mapInArrow(run, "host string, part int, prefix long, n long, below long")


class Runs:
    """Runs by host and part: what a round of pages is matched against."""

    def __init__(self, rows):
        self.of = {(r["host"], r["part"]): np.sort(np.array(r["runs"], np.int64)) for r in rows}

    def places(self, host: str, part: int, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places at which runs begin, and the hashes there."""
        runs = self.of.get((host, part))
        if runs is None or not len(hashes := prefixes(tokens)):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(runs[np.minimum(np.searchsorted(runs, hashes), len(runs) - 1)] == hashes)
        return at, hashes[at]


def rounds(pages: DataFrame, runs: DataFrame) -> Iterator[tuple[DataFrame, object]]:
    """(pages (page_id, url, host, html) of a round, broadcast Runs of their hosts): one round for every ``ROUND`` runs."""
    n = max(1, -(-runs.count() // ROUND))
    for k in range(n):
        own = lambda df: df.where(F.pmod(F.xxhash64("host"), F.lit(n)) == k) if n > 1 else df  # noqa: E731, B023
        rows = own(runs).groupBy("host", "part").agg(F.collect_list("prefix").alias("runs")).collect()
        yield own(pages.select("page_id", "url", _host().alias("host"), "html")), pages.sparkSession.sparkContext.broadcast(Runs(rows))


def _counted(pages: DataFrame, maybe: DataFrame) -> DataFrame:
    """(host, part, prefix, n): in how many distinct streams of its host each run is."""

    def hits(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for host, page in zip(*[c.to_pylist() for c in batch.columns]):
                    if (host, ARTICLE) not in shared.value.of and (host, OUTSIDE) not in shared.value.of:
                        continue
                    main, _, outside = _parts(page)
                    for part, text in ((ARTICLE, "\n".join(main)), (OUTSIDE, outside)):
                        found = np.unique(shared.value.places(host, part, _tokens(text))[1])
                        if n := len(found):
                            copy = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1
                            columns = ([host] * n, [part] * n, found, [copy] * n)
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["host", "part", "prefix", "copy"])

        return run

    found = None
    for own, shared in rounds(pages, maybe):
        rows = own.select("host", "html").mapInArrow(hits(shared), "host string, part int, prefix long, copy long")
        found = rows if found is None else found.unionByName(rows)
    return found.distinct().groupBy("host", "part", "prefix").agg(F.count(F.lit(1)).alias("n"))


def boilerplate_runs(pages: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(host, part, prefix) of the runs to remove."""
    named = scratch.written(named_runs(streams(pages)), "runs-named")
    total = named.where("prefix = -1").groupBy(F.col("host").alias("at"), F.col("part").alias("in")).agg(F.sum("n").alias("of"), F.sum("below").alias("all_below"))
    least = F.when(F.col("in") == ARTICLE, F.greatest(F.lit(COMMON), F.floor(F.col("of") / 2) + 1)).otherwise(F.greatest(F.lit(2), F.ceil(F.col("of") / 10)))
    total = total.select("at", "in", "all_below", least.alias("least"))
    runs = named.where("prefix >= 0").groupBy("host", "part", "prefix").agg(F.sum("n").alias("n"), F.sum("below").alias("below"))
    runs = runs.join(total, (F.col("host") == F.col("at")) & (F.col("part") == F.col("in"))).where("n + all_below - below >= least")
    runs = scratch.written(runs.select("host", "part", "prefix", "n", "least"), "runs-likely")
    sure, maybe = runs.where("n >= least").select("host", "part", "prefix"), runs.where("n < least")
    if maybe.isEmpty():
        return sure
    n = _counted(pages, maybe.select("host", "part", "prefix")).select(F.col("host").alias("at"), F.col("part").alias("in"), F.col("prefix").alias("run"), F.col("n").alias("exact"))
    more = maybe.join(n, (F.col("host") == F.col("at")) & (F.col("part") == F.col("in")) & (F.col("prefix") == F.col("run"))).where("exact >= least")
    return sure.unionByName(scratch.written(more.select("host", "part", "prefix"), "runs-counted"))


def unique_text(candidates: list[str], places) -> str:
    """The blocks without the tokens that runs from these places on cover; all of them if fewer than RUN tokens would be left."""
    words = [b.split() for b in candidates]
    n = sum(map(len, words))
    covered = np.zeros(n + 1, np.int64)
    for p in places:
        covered[p] += 1
        covered[min(n, p + RUN)] -= 1
    gone = np.cumsum(covered)[:n] > 0
    if n - int(gone.sum()) < RUN:
        return "\n".join(candidates)
    out, at = [], 0
    for w in words:
        left = [x for x, g in zip(w, gone[at : at + len(w)]) if not g]
        at += len(w)
        if left:
            out.append(" ".join(left))
    return "\n".join(out)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    spark = common.prepare(pages.sparkSession)

    def cut(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = []
                for host, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    main, open_, _ = _parts(page)
                    candidates = main or open_
                    text = "\n".join(candidates)
                    if (host, part := OUTSIDE if not main else ARTICLE) in shared.value.of:
                        at, _ = shared.value.places(host, part, _tokens(text))
                        text = unique_text(candidates, at) if len(at) else text
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

        return run

    with common.Scratch(spark) as scratch:
        rows = None
        for own, shared in rounds(pages, boilerplate_runs(pages, scratch)):
            found = own.mapInArrow(cut(shared), "page_id long, url string, text string")
            rows = found if rows is None else rows.unionByName(found)
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
