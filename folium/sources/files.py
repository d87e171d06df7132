"""Documents from files: Markdown and text as a whole, PDF pages, and input checks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

MARKDOWN, PDF = (".md", ".markdown"), (".pdf",)


def accepted(path: Column, kinds: tuple[str, ...] = MARKDOWN + PDF) -> Column:
    """Whether a path ends in one of the suffixes, in any case."""
    lower = F.lower(path)
    found = F.lit(False)
    for kind in kinds:
        found = found | lower.endswith(kind)
    return F.coalesce(found, F.lit(False))


def _named(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split(F.input_file_name() if "path" not in files.columns else F.col("path"), "/"), -1)
    return files.withColumn("doc_name", X.doc_key(name))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, doc_name, text): each Markdown file as one text; doc_id is a hash of its path."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    rows = rows.select(F.input_file_name().alias("path"), F.col("value").alias("text")).where(accepted(F.col("path"), MARKDOWN))
    return _named(rows).select(F.xxhash64("path").alias("doc_id"), "doc_name", "text")


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, doc_name, page_no, text, token_count) of the pages of PDF files: the text that content streams show, plain or
    deflated, with one-byte fonts.  Files that can't be read have no pages."""
    return pages_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def pages_of(files: DataFrame) -> DataFrame:
    """The pages of the PDF files among files (path, content)."""
    import pyarrow as pa

    files = _named(files.where(accepted(F.col("path"), PDF)))

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, name, content in zip(*[c.to_pylist() for c in batch.columns]):
                texts = pdf_texts(content)
                n = len(texts)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id] * n, pa.int64()), "doc_name": pa.array([name] * n, pa.string()), "page_no": pa.array(range(1, n + 1), pa.int32()), "text": pa.array(texts, pa.string())})

    rows = files.select(F.xxhash64("path").alias("doc_id"), "doc_name", "content").mapInArrow(pages, "doc_id long, doc_name string, page_no int, text string")
    return rows.withColumn("token_count", X.token_count(F.col("text")))


_OBJECT = re.compile(rb"(?:^|[\r\n ])(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|T\*|\b(?:Tj|TJ|Td|TD|Tm|ET)\b|'|\"|-?\d+(?:\.\d+)?")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else _ESCAPES.get(c, b"" if c in b"\r\n" else c)

    return re.sub(rb"\\([0-7]{1,3}|.)", plain, token[1:-1], flags=re.DOTALL)


def _text_of(stream: bytes) -> str:
    out: list[bytes] = []
    held: list[bytes] = []
    numbers: list[float] = []
    for m in _SHOWN.finditer(stream):
        token = m[0]
        if token[:1] in b"(<":
            held.append(_literal(token))
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                out.append(b"\n")
            out += held
            held, numbers = [], []
        elif token in (b"T*", b"Td", b"TD", b"Tm", b"ET"):
            if token != b"Td" and token != b"TD" or len(numbers) > 1 and numbers[-1] != 0:
                out.append(b"\n")
            elif out:
                out.append(b" ")
            held, numbers = [], []
        else:
            number = float(token)
            if held and number < -200:  # a wide step back inside TJ is a space
                held.append(b" ")
            numbers.append(number)
    lines = (re.sub(r" +", " ", x).strip() for x in b"".join(out).decode("cp1252", "replace").split("\n"))
    return "\n".join(x for x in lines if x)


def pdf_texts(content: bytes) -> list[str]:
    """The text of each page of a PDF, in page order; no pages if it can't be read."""
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}

    def data(number: int) -> bytes:
        body = objects.get(number, b"")
        m = _STREAM.search(body)
        if not m:
            return b""
        if b"/FlateDecode" in body[: m.start()]:
            try:
                return zlib.decompressobj().decompress(m[1])
            except zlib.error:
                return b""
        return m[1]

    for number in [n for n, body in objects.items() if b"/ObjStm" in body]:
        body, inner = objects[number], data(number)
        first = re.search(rb"/First\s+(\d+)", body)
        if first and inner:
            heads = list(map(int, inner[: int(first[1])].split()))
            spans = list(zip(heads[::2], heads[1::2]))
            for (k, at), (_, end) in zip(spans, spans[1:] + [(0, len(inner))]):
                objects.setdefault(k, inner[int(first[1]) + at : int(first[1]) + end])
    pages: list[int] = []
    seen: set[int] = set()

    def walk(number: int) -> None:
        if number in seen:
            return
        seen.add(number)
        body = objects.get(number, b"")
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.DOTALL)
        if kids:
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                walk(int(k))
        elif re.search(rb"/Type\s*/Page\b", body):
            pages.append(number)

    for number, body in objects.items():
        root = re.search(rb"/Type\s*/Catalog\b", body) and re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", body)
        if root:
            walk(int(root[1]))
    found = []
    for number in pages:
        contents = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+)\s+\d+\s+R)", objects[number], re.DOTALL)
        refs = re.findall(rb"(\d+)\s+\d+\s+R", contents[1]) if contents and contents[1] is not None else [contents[2]] if contents else []
        found.append("\n".join(filter(None, (_text_of(data(int(k))) for k in refs))))
    return found
