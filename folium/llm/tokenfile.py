"""Token files of patched frame-of-reference blocks.

A data set of token ids is a folder of binary files.  A file is a row of frames, a frame holds whole documents:

    u32 length of what follows
    "PFR1", u32 part, u32 seq, u32 documents, u64 tokens, u32 blocks
    u8  null flag, i64 doc_id, u32 tokens     columns, one entry a document
    u32 minimum, u8 width, u8 exceptions      columns, one entry a block of 128 ids
    u32 block start                           blocks + 1 offsets into the payload: the index
    payload                                   a block: 16 * width bytes, then its exceptions
    line feed

A block subtracts its minimum and packs all differences at the width that the 90th percentile needs.  Wider
differences keep their low bits in place and stand whole in the exception list (u8 position, u32 difference).
The last block of a frame is filled up with its minimum.  ``part`` counts ranges of doc_id in ascending order and
``seq`` the frames of one, so (part, seq) is the order of the data set whatever the files are called.
``<folder>/index`` (Parquet) has the first token of every part.

Frames go through Spark's own text writer (a frame is a "line" of bytes), so any store that Spark writes will do
and a lost task leaves nothing behind.

Defined results: null text is empty; null doc_ids come first; rows with one doc_id follow one another, in the order of
their texts' hashes, whatever range they are in; an empty table makes no frame.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

MAGIC, BLOCK, PERCENTILE = b"PFR1", 128, 0.9
#: Tokens from which a frame is closed, and frames of a file.
FRAME_TOKENS, FILE_FRAMES = 65_536, 128
#: Bytes of texts that are encoded at once, and bytes of the chunks and their ids that a worker keeps.
GROUP_BYTES, KNOWN_BYTES = 8 << 20, 24 << 20
#: New chunks that are split into words at once.
NEW = 20_000
_HEAD = "<4sIIIQI"
_WIDE = np.dtype([("at", "u1"), ("value", "<u4")])
#: The fast split of ``bpe``, with line feeds as words of their own.
_COMMON_LINES = re.compile(bpe._COMMON.pattern + "|\n")


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value below 2**32 needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _carrier(width: int) -> str:
    """The type whose bytes hold a value of so many bits."""
    return "<u2" if width <= 16 else "<u4"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(minimums, widths, exceptions, starts, payload) of the blocks of ids."""
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.empty(0, "<u4"), np.empty(0, "u1"), np.empty(0, "u1"), np.zeros(1, "<u4"), b""
    values = np.empty(blocks * BLOCK, np.uint32)
    values[: len(ids)] = ids
    values[len(ids) :] = ids[(blocks - 1) * BLOCK :].min()
    values = values.reshape(blocks, BLOCK)
    least = values.min(axis=1)
    values -= least[:, None]
    need = _bits(values)
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.partition(need, rank, axis=1)[:, rank]
    over = need > width[:, None]
    count = over.sum(axis=1)
    sizes = width.astype(np.int64) * (BLOCK // 8) + count * _WIDE.itemsize
    starts = np.zeros(blocks + 1, "<u4")
    np.cumsum(sizes, out=starts[1:])
    payload = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            raw = values[rows].astype(_carrier(w))[:, :, None].view(np.uint8)
            bits = np.unpackbits(raw, axis=2, count=int(w), bitorder="little")
            packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            payload[starts[rows].astype(np.int64)[:, None] + np.arange(packed.shape[1])] = packed
    row, at = np.nonzero(over)
    if len(row):
        lists = np.empty(len(row), _WIDE)
        lists["at"], lists["value"] = at, values[row, at]
        first = np.concatenate(([0], np.cumsum(count)))[row]
        where = starts[row] + width[row].astype(np.int64) * (BLOCK // 8) + (np.arange(len(row)) - first) * _WIDE.itemsize
        payload[where[:, None] + np.arange(_WIDE.itemsize)] = lists.view(np.uint8).reshape(len(row), -1)
    return least.astype("<u4"), width, count.astype(np.uint8), starts, payload.tobytes()


def unpack(least: np.ndarray, width: np.ndarray, count: np.ndarray, starts: np.ndarray, payload: np.ndarray, n: int) -> np.ndarray:
    """The n ids of packed blocks."""
    values = np.zeros((len(least), BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            packed = payload[starts[rows].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 8))]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
            whole = np.zeros((len(rows), BLOCK, 8 * np.dtype(_carrier(w)).itemsize), np.uint8)
            whole[:, :, :w] = bits
            values[rows] = np.packbits(whole.reshape(len(rows), -1), axis=1, bitorder="little").view(_carrier(w))
    if total := int(count.sum()):
        row = np.repeat(np.arange(len(count)), count)
        first = np.concatenate(([0], np.cumsum(count.astype(np.int64))))[row]
        where = starts[row] + width[row].astype(np.int64) * (BLOCK // 8) + (np.arange(total) - first) * _WIDE.itemsize
        lists = payload[where[:, None] + np.arange(_WIDE.itemsize)].reshape(-1).view(_WIDE)
        values[row, lists["at"]] = lists["value"]
    return (values + least[:, None]).reshape(-1)[:n]


def squeezed(ids: np.ndarray) -> bytes:
    """Ids on their way to a range: in two bytes each where that does, else in four."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.tobytes()


def unsqueezed(raw) -> np.ndarray:
    raw = memoryview(raw)
    return np.frombuffer(raw[1:], f"<u{raw[0]}").astype(np.uint32)


def frame(part: int, seq: int, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    least, width, count, starts, payload = pack(ids)
    body = b"".join((
        struct.pack(_HEAD, MAGIC, part, seq, len(doc_ids), len(ids), len(least)),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array(sizes, "<u4").tobytes(),
        least.tobytes(), width.tobytes(), count.tobytes(), starts.tobytes(), payload,
    ))
    return struct.pack("<I", len(body)) + body


def frames(content: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, seq, null flags, doc_ids, sizes, ids) of each frame of a file."""
    data, at = np.frombuffer(content, np.uint8), 0
    while at < len(data):
        (length,) = struct.unpack_from("<I", content, at)
        body = at + 4
        magic, part, seq, docs, tokens, blocks = struct.unpack_from(_HEAD, content, body)
        if magic != MAGIC:
            raise ValueError("not a frame of a token file")
        body += struct.calcsize(_HEAD)

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal body
            found = np.frombuffer(content, kind, n, body)
            body += found.nbytes
            return found

        null, ids, sizes = column("u1", docs), column("<i8", docs), column("<u4", docs)
        least, width, count, starts = column("<u4", blocks), column("u1", blocks), column("u1", blocks), column("<u4", blocks + 1)
        yield part, seq, null, ids, sizes, unpack(least, width, count, starts, data[body : body + int(starts[-1])], tokens)
        at += 4 + length + 1


class LibraryEncoder(bpe.RankBpe):
    """The ``tokenizers`` library with a memo of words: texts are normalised and split here, and the library's model encodes each
    distinct word once for each worker.

    ``encode_all`` takes many texts: Arrow divides them into chunks at ASCII white space and finds each chunk in a table of
    those that the worker knows, so that only new chunks are split into words.  No word or special token of the public vocabularies has
    white space, and no character composes or changes across it, so the ids of a text are those of its chunks; with other
    vocabularies a text is one chunk."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        super().__init__(path)
        self.ranks = {}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.chunked = self.common is not None and bool(self.suffix) and not any(c.isspace() for t in self.added for c in t)
        if self.chunked:
            # The same model for words that are split and mapped already.
            self.by_space = Tokenizer(self.model)
            self.by_space.pre_tokenizer = WhitespaceSplit()
            self.lines = regex.compile(bpe.SPLIT + r"|\n")
            self.ending = np.zeros(max(self.vocab.values()) + 1, bool)
            self.spaced = self.printable[:32] + " " + self.printable[33:]
            self.ending[[i for t, i in self.vocab.items() if t.endswith(self.suffix)]] = True
        self.known = pa.array([], pa.string())
        self.known_ids = pa.array([], pa.list_(pa.uint32()))
        self.uses = np.empty(0, np.int64)

    def word(self, word: str) -> bytes:
        if len(word) > bpe.MEMO_LEN:
            return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()
        return array("I", [t.id for t in self.model.tokenize(self.mapped(word))]).tobytes()

    def of_words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word, by few calls of the library: a word ends with the one token that has the suffix."""
        for k in range(0, len(words), 256):
            own = words[k : k + 256]
            text = " ".join(own)
            if not (text.isascii() and text.isprintable()):
                text = text.encode("utf-8").decode("latin-1").translate(self.spaced)
            ids = np.array(self.by_space.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ending[ids]) * 4 + 4).tolist()
            if len(ends) != len(own):
                yield from map(self.word, own)
                continue
            raw = ids.tobytes()
            yield from [raw[i:j] for i, j in zip([0, *ends], ends)]

    def listed(self, chunks: pa.Array) -> pa.Array:
        """The ids of each chunk, as ``encode`` gives them."""
        texts = chunks.to_pylist()
        joined = "".join([t + "\n" for t in texts])
        if self.special is not None and self.special.search(joined):
            found = [self.encode(t) for t in texts]
            ends = np.cumsum([0, *map(len, found)]) // 4
        else:
            words = _COMMON_LINES.findall(joined.lower()) if not bpe._UNCOMMON.search(joined) else self.lines.findall(self.normalise(joined))
            made = dict.fromkeys(words)
            made.pop("\n", None)
            made = dict(zip(made, self.of_words(list(made)))) | {"\n": b""}
            found = list(map(made.__getitem__, words))
            last = np.fromiter(map("\n".__eq__, words), bool, len(words))
            ends = np.append(0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))[last]) // 4
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), "<u4")))

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (null: none), as ``encode`` gives them."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.chunked:
            yield from (np.frombuffer(self.encode(t.as_py()), "<u4") for t in texts)
            return
        lists = pc.ascii_split_whitespace(texts)
        ends, chunks = np.cumsum(pc.list_value_length(lists).to_numpy()), lists.flatten()
        at = pc.index_in(chunks, value_set=self.known)
        new = chunks.filter(at.is_null()).dictionary_encode()
        del texts, lists, chunks
        at = pc.fill_null(at, -1).to_numpy().copy()
        at[at < 0] = new.indices.to_numpy() + len(self.known)
        new = new.dictionary
        ids = pa.concat_arrays([self.known_ids, *(self.listed(new[k : k + NEW]) for k in range(0, len(new), NEW))])
        start = 0
        for end in ends.tolist():
            yield ids.take(pa.array(at[start:end])).flatten().to_numpy()
            start = end
        self.keep(pa.concat_arrays([self.known, new]), ids, np.bincount(at, minlength=len(ids)))

    def keep(self, chunks: pa.Array, ids: pa.Array, uses: np.ndarray) -> None:
        """Keeps chunks for the next texts; long ones never, and where they take too much those that were used most."""
        uses[: len(self.uses)] += self.uses
        length = pc.binary_length(chunks).to_numpy()
        rows = np.flatnonzero(length <= bpe.MEMO_LEN)
        if chunks.nbytes + ids.nbytes > KNOWN_BYTES:
            takes = length + 4 * pc.list_value_length(ids).to_numpy() + 8
            rows = rows[np.argsort(-uses[rows], kind="stable")]
            rows = np.sort(rows[np.cumsum(takes[rows]) <= KNOWN_BYTES // 2])
            uses >>= 1
        if len(rows) < len(chunks):
            chunks, ids, uses = chunks.take(pa.array(rows)), ids.take(pa.array(rows)), uses[rows]
        self.known, self.known_ids, self.uses = chunks, ids, uses


_made: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _made:
        _made[path] = LibraryEncoder(path)
    return _made[path]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to ``GROUP_BYTES``; a batch that is larger stays as it is."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and size + batch.nbytes > GROUP_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def cuts(docs: DataFrame, parts: int) -> list[tuple[bool, int, int]]:
    """The first keys (not null, doc_id, hash of the text) of all ranges but the first, for about equal ranges in their order.

    They come from about 64 rows a range, chosen by a hash of the text, so that rows of one doc_id spread as well."""
    keys = docs.select("doc_id", F.xxhash64("text", "doc_id").alias("tie"))
    every = max(1, docs.count() // (64 * parts))
    rows = keys.where(F.pmod(F.xxhash64("tie"), F.lit(every)) == 0).collect() if parts > 1 else []
    keys = sorted((r[0] is not None, r[0] or 0, r[1]) for r in rows)
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int | None = 2) -> None:
    """Encodes the text of docs (doc_id, text), ends each document with end_id and writes the token files.

    Texts are encoded where they are read; what is dealt to ranges are packed ids."""
    spark = common.prepare(docs.sparkSession)
    n = common.partitions(spark)
    docs = docs.select("doc_id", "text")
    first = cuts(docs, n)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in grouped(batches):
            ids, ties = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            part = [bisect.bisect_right(first, (d is not None, d or 0, t)) for d, t in zip(ids, ties)]
            packed = [squeezed(np.concatenate((x, end))) for x in encoder.encode_all(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["part", "doc_id", "tie", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq = None, 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"frame": pa.array([frame(at, seq, doc_ids, [len(x) for x in held], np.concatenate(held))], pa.binary())})

        for batch in batches:
            for part, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if size >= FRAME_TOKENS or held and part != at:
                    yield closed()
                    doc_ids, held, size, seq = [], [], 0, seq + 1
                if part != at:
                    at, seq = part, 0
                doc_ids.append(doc_id)
                held.append(unsqueezed(ids.as_buffer()))
                size += len(held[-1])
        if held:
            yield closed()

    encoded = docs.select("doc_id", "text", F.xxhash64("text", "doc_id").alias("tie")).mapInArrow(common.lean(encode), "part int, doc_id long, tie long, ids binary")
    (encoded.repartitionById(n, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie")
     .select("part", "doc_id", "ids").mapInArrow(run, "frame binary")
     .select(F.col("frame").cast("string"))
     .write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_FRAMES).text(f"{folder}/data"))


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """A row for each document of the token files: doc_id, start, n_tokens, ids_crc32, and its ids if asked for."""
    common.prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part, seq, null, doc_ids, sizes, ids in frames(content.as_py()):
                    ends = np.cumsum(sizes, dtype=np.int64)
                    starts = ends - sizes
                    raw = memoryview(ids.astype("<u4").tobytes())
                    n = len(sizes)
                    columns = {
                        "part": pa.array(np.full(n, part, np.int32)), "seq": pa.array(np.full(n, seq, np.int32)), "item": pa.array(np.arange(n, dtype=np.int32)),
                        "doc_id": pa.array(doc_ids, pa.int64(), mask=null.astype(bool)), "n_tokens": pa.array(sizes.astype(np.int64)),
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                    }
                    if with_ids:
                        columns["input_ids"] = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "part int, seq int, item int, doc_id long, n_tokens long, ids_crc32 long" + ", input_ids array<int>" * with_ids
    files = spark.read.format("binaryFile").load(f"{folder}/data").select("content")
    rows = files.mapInArrow(run, schema)
    base = spark.read.parquet(f"{folder}/index").select("part", "base")
    before = Window.partitionBy("part").orderBy("seq", "item").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    return rows.join(base, "part").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", *["input_ids"] * with_ids)


def write_index(spark: SparkSession, folder: str) -> None:
    """Writes the first token of every part, from the frames' heads; a row for each part, not for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at, found = content.as_py(), 0, []
                while at < len(data):
                    (length,) = struct.unpack_from("<I", data, at)
                    found.append(struct.unpack_from(_HEAD, data, at + 4))
                    at += 4 + length + 1
                yield pa.RecordBatch.from_pydict({"part": pa.array([x[1] for x in found], pa.int32()), "n_docs": pa.array([x[3] for x in found], pa.int64()), "n_tokens": pa.array([x[4] for x in found], pa.int64())})

    heads = spark.read.format("binaryFile").load(f"{folder}/data").select("content").mapInArrow(run, "part int, n_docs long, n_tokens long")
    parts = heads.groupBy("part").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{folder}/index")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int | None = 2) -> DataFrame:
    """Writes docs as token files in the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = common.new_path(spark, "tokens")
    write_tokens(docs, vocabulary, folder, end_id)
    write_index(spark, folder)
    return read_tokens(spark, folder)
