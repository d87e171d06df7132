"""BPE encoding and decoding with contiguous rank arrays.

A word is a row of parts given by their boundaries, with the merge rank of every adjacent pair beside them.
The smallest rank is sought by a scan, the boundary between its two parts is deleted, and the two ranks
beside it are looked up again, until no pair has a rank.  Scans beat a heap on short words; words longer than
``LONG`` take a heap with the same order (rank, then position), so that time stays near-linear.

Defined results: null text is empty and has no tokens; ``decode`` ignores ids outside the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: Bytes of a word from which a heap takes the place of scans.
LONG = 256
#: Entries of each of a memo's two generations, and code points of the longest key kept: some 50 MB a worker at most.
MEMO, MEMO_LEN = 120_000, 48
_NO_RANK = 1 << 60
#: The split of the public vocabularies, and, for texts in lower case without other characters than those of ``_COMMON``, the same split
#: in a form that the faster ``re`` module takes: letters and numbers of Latin-1, Latin Extended-A and Cyrillic are spelt out.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\u0100-\u012f\u0131-\u017f\u0430-\u0481\u048a-\u052f"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_UNCOMMON = re.compile("[^\n\t -~\xa1-\u012f\u0131-\u017f\u0400-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")
_COMMON = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


class Memo(dict):
    """What ``make`` gives for a key, kept in two generations: when the new one is full it becomes the old one.

    It lasts as long as the worker, so its size is bounded by the number of entries and by the length of their keys."""

    def __init__(self, make, limit: int = MEMO):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(key) <= MEMO_LEN:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class RankBpe:
    """Encoder and decoder for a ``tokenizers`` JSON file: BPE over byte-level words with a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.alphabet = byte_alphabet()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.added = added
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in added.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.common = _COMMON if split == SPLIT else None
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.of_word = Memo(self.word)
        self.printable = "".join(self.alphabet)

    def merge(self, word: str) -> list[str]:
        """Parts of one word (in byte-level characters) after all merges."""
        suffix, ranks = self.suffix, self.ranks
        n = len(word)
        if n > LONG:
            return self._merge_long(word)

        def part(i: int, j: int) -> str:
            return word[i:j] + suffix if j == n else word[i:j]

        bounds = list(range(n + 1))
        near = [ranks.get((part(i, i + 1), part(i + 1, i + 2)), _NO_RANK) for i in range(n - 1)]
        while near:
            least = min(near)
            if least == _NO_RANK:
                break
            k = near.index(least)
            del bounds[k + 1], near[k]
            if k < len(near):
                near[k] = ranks.get((part(bounds[k], bounds[k + 1]), part(bounds[k + 1], bounds[k + 2])), _NO_RANK)
            if k:
                near[k - 1] = ranks.get((part(bounds[k - 1], bounds[k]), part(bounds[k], bounds[k + 1])), _NO_RANK)
        return [part(i, j) for i, j in zip(bounds, bounds[1:])]

    def _merge_long(self, word: str) -> list[str]:
        n, ranks = len(word), self.ranks
        parts: list[str | None] = [*word[:-1], word[-1] + self.suffix]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for x in (left[i], i):
                if x >= 0 and (y := right[x]) < n and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p is not None]

    def normalise(self, text: str) -> str:
        # Lower case goes character by character, so a final sigma is the common one.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def mapped(self, word: str) -> str:
        """The byte-level characters of a word."""
        return word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.printable)

    def word(self, word: str) -> bytes:
        """Ids of one word of a normalised text."""
        vocab = self.vocab
        return array("I", [i for p in self.merge(self.mapped(word)) if (i := vocab.get(p)) is not None]).tobytes()

    def plain(self, text: str) -> bytes:
        """Ids of a text in which special tokens are ordinary text."""
        if self.common is not None and not _UNCOMMON.search(text):
            words = self.common.findall(text.lower())
        else:
            words = self.words.findall(self.normalise(text))
        return b"".join(map(self.of_word.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit integers; each distinct word is encoded once for each worker."""
        text = text or ""
        if self.special is None or "<" not in text:
            return self.plain(text)
        found, at = [], 0
        for m in self.special.finditer(text):
            found += [self.plain(text[at : m.start()]), array("I", [self.added[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*found, self.plain(text[at:])])

    def decode(self, ids: Iterable[int]) -> str:
        get = self.tokens.get
        return " ".join([t for i in ids if (t := get(i)) is not None])


_made: dict[str, RankBpe] = {}


def rank_bpe(path: str) -> RankBpe:
    """The worker's encoder for a vocabulary file; its memo lasts as long as the worker."""
    if path not in _made:
        _made[path] = RankBpe(path)
    return _made[path]


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with ``n_tokens`` (long), ``input_ids`` (array of int) and ``decoded`` (string) in front of the
    columns it has; columns of these names are replaced.  One row for each row; nothing is shuffled."""
    common.prepare(docs.sparkSession)
    new = ("n_tokens", "input_ids", "decoded")
    kept = docs.select([c for c in docs.columns if c not in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = rank_bpe(vocabulary)
        for batch in batches:
            ids = [array("I", bpe.encode(t)) for t in batch.column(text).to_pylist()]
            columns = {
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "input_ids": pa.array(ids, pa.list_(pa.int32())),
                "decoded": pa.array([bpe.decode(x) for x in ids], pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns | dict(zip(batch.schema.names, batch.columns)))

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), *kept.schema.fields])
    return kept.mapInArrow(common.lean(run), schema)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of (doc_id, text)."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = rank_bpe(vocabulary)
        sha = hashlib.sha256
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids) // 4)
                ids_sha.append(sha(ids).hexdigest())
                decoded_sha.append(sha(bpe.decode(array("I", ids)).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())})

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
