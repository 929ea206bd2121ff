"""Token ids in files of directly addressable codes, written and read by Spark tasks."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import prepare
from starloom.session import barrier

MAGIC = b"DACTOK01"
END_ID = 1
#: Ids in a file, which a task holds while it encodes them; a file ends with the document that reaches it.
FILE_TOKENS = 1_000_000
#: Bits between two entries of a rank directory.
RANK_BITS = 512
#: Pieces of text whose ids a worker keeps, and as many that are set aside.
CACHE_PIECES = 300_000

# ---------------------------------------------------------------- the format


def chunk_widths(ids: np.ndarray) -> list[int]:
    """Widths of the levels, lowest bits first, that need the least space for these ids.

    Level k holds one chunk for every id that needs more bits than the levels before have, and a bitmap with one bit per
    chunk saying whether the id goes on. Chunks are whole or half bytes. The best cut is found by dynamic programming
    over the counts of ids by length.
    """
    values = np.bincount(ids)
    bits = np.maximum(1, np.ceil(np.log2(np.arange(len(values)) + 1.0))).astype(np.int64)
    lengths = np.bincount(bits, weights=values, minlength=33).astype(np.int64)
    longer = np.cumsum(lengths[::-1])[::-1]  # ids of at least so many bits
    top = int(np.nonzero(lengths)[0].max()) if len(ids) else 8
    top = max(8, -(-top // 4) * 4)
    best: dict[int, tuple[float, list[int]]] = {top: (0.0, [])}
    for at in range(top - 4, -1, -4):
        rest = float(longer[at + 1]) if at else float(len(ids))
        options = []
        for width in (4, 8, 16):
            if at + width in best:
                more = 1.07 if at + width < top else 0.0  # bitmap and rank directory
                options.append((rest * (width + more) + best[at + width][0], [width, *best[at + width][1]]))
        if options:
            best[at] = min(options)
    return best[0][1]


def _packed(chunks: np.ndarray, width: int) -> bytes:
    if width == 4:
        even = np.append(chunks, 0)[: len(chunks) + len(chunks) % 2].astype(np.uint8)
        return (even[0::2] | (even[1::2] << 4)).astype(np.uint8).tobytes()
    return chunks.astype("u1" if width == 8 else "<u2").tobytes()


def encode_codes(ids: np.ndarray) -> bytes:
    """All levels: for each its width, count, chunks, continuation bitmap and rank directory."""
    widths = chunk_widths(ids)
    out = [struct.pack("<B", len(widths))]
    rest = ids.astype(np.uint32)
    for level, width in enumerate(widths):
        chunks = rest & np.uint32((1 << width) - 1)
        on = (rest >> np.uint32(width)) > 0
        last = level == len(widths) - 1
        bitmap = b"" if last else np.packbits(on, bitorder="little").tobytes()
        ranks = b""
        if not last:
            padded = np.zeros(-(-len(on) // RANK_BITS) * RANK_BITS, dtype=np.uint32)
            padded[: len(on)] = on
            ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, RANK_BITS).sum(axis=1))]).astype("<u4").tobytes()
        body = _packed(chunks, width)
        out += [struct.pack("<BQIII", width, len(chunks), len(body), len(bitmap), len(ranks)), body, bitmap, ranks]
        rest = rest[on] >> np.uint32(width)
    return b"".join(out)


class Codes:
    """Reads encoded ids in place: one by number, or a stretch."""

    def __init__(self, data: memoryview):
        (levels,) = struct.unpack_from("<B", data, 0)
        at, self.levels = 1, []
        for _ in range(levels):
            width, count, body, bitmap, ranks = struct.unpack_from("<BQIII", data, at)
            at += struct.calcsize("<BQIII")
            parts = []
            for size in (body, bitmap, ranks):
                parts.append(data[at : at + size])
                at += size
            self.levels.append((width, count, np.frombuffer(parts[0], "<u2" if width == 16 else "u1"), np.frombuffer(parts[1], "u1"), np.frombuffer(parts[2], "<u4")))

    def __len__(self) -> int:
        return self.levels[0][1] if self.levels else 0

    def __getitem__(self, index: int) -> int:
        """The id at a place: a chunk and a bit of each level it needs, and one rank; nothing else is decoded."""
        if not 0 <= index < len(self):
            raise IndexError(index)
        value = shift = 0
        for width, _, chunks, bitmap, ranks in self.levels:
            chunk = int(chunks[index]) if width > 4 else int(chunks[index >> 1]) >> (4 * (index & 1)) & 15
            value |= chunk << shift
            if not len(bitmap) or not bitmap[index >> 3] >> (index & 7) & 1:
                return value
            block = index // RANK_BITS
            first = block * RANK_BITS // 8
            before = int(np.unpackbits(bitmap[first : (index >> 3) + 1], bitorder="little")[: index - block * RANK_BITS].sum())
            index, shift = int(ranks[block]) + before, shift + width
        return value

    def stretch(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to before ``end``; the rank directory gives where each level begins."""
        return self._level(0, start, end)

    def _level(self, level: int, start: int, end: int) -> np.ndarray:
        width, _, chunks, bitmap, ranks = self.levels[level]
        if width > 4:
            own = chunks[start:end].astype(np.uint32)
        else:
            pair = chunks[start >> 1 : (end + 1) >> 1]
            own = np.stack([pair & 15, pair >> 4], axis=1).reshape(-1)[start & 1 :][: end - start].astype(np.uint32)
        if len(bitmap) and end > start:
            block = start // RANK_BITS
            bits = np.unpackbits(bitmap[block * RANK_BITS // 8 : (end + 7) >> 3], bitorder="little")
            on = bits[start - block * RANK_BITS : end - block * RANK_BITS].astype(bool)
            first = int(ranks[block]) + int(bits[: start - block * RANK_BITS].sum())
            own[on] |= self._level(level + 1, first, first + int(on.sum())) << np.uint32(width)
        return own


def encode_file(before: int, doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """A file: magic, ids in the part's files before, number of documents, which have an id, ids, first places, codes."""
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    named = np.array([x or 0 for x in doc_ids], dtype="<i8")
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    return b"".join([MAGIC, struct.pack("<QQ", before, len(doc_ids)), known.tobytes(), named.tobytes(), starts.tobytes(), encode_codes(ids)])


class TokenFile:
    """A file's documents and ids."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.before, count = struct.unpack_from("<QQ", data, 8)
        at = 24
        known = np.frombuffer(data, "u1", count, at)
        named = np.frombuffer(data, "<i8", count, at + count)
        self.doc_ids = [int(x) if k else None for x, k in zip(named, known, strict=True)]
        self.starts = np.frombuffer(data, "<i8", count + 1, at + 9 * count)
        self.codes = Codes(memoryview(data)[at + 9 * count + 8 * (count + 1) :])

    def document(self, number: int) -> np.ndarray:
        return self.codes.stretch(int(self.starts[number]), int(self.starts[number + 1]))


# ---------------------------------------------------------------- ids of texts


class Kept(dict):
    """Values made once per key. When it is full the values are set aside; those that are asked for again come back."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.aside = make, most, {}

    def __missing__(self, key):
        value = self.aside.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.aside = dict(self)
            self.clear()
        self[key] = value
        return value


#: Printable ASCII but the apostrophe, which starts endings that the pre-tokenizer splits off, and Latin-1 letters.
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
#: What the pre-tokenizer makes of such a piece in lower case: runs of letters, single digits, runs of anything else.
_RUNS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Byte-level vocabularies write bytes that are not printable in Latin-1 as the characters from 256 on.
_SHOWN = [i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or 174 <= i <= 255]
_BYTE_LEVEL = {x: 256 + n for n, x in enumerate(i for i in range(256) if i not in _SHOWN)}


class Encoder:
    """Ids of whole texts by a tokenizers file whose normalizer lowers letters, piece by piece.

    The pieces between ASCII white space are encoded apart and kept: this vocabulary's normalizer and pre-tokenizer drop
    white space and never look across it, so the ids are those of the whole text. Pieces of ASCII and Latin-1 letters are
    their own normal form; their runs go to the library's model as they are, every other piece goes through all its
    steps. A text that spells a special token is encoded in one go, as these are found before letters are lowered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [x.content.encode().lower() for x in self.whole.get_added_tokens_decoder().values()]
        self.runs = Kept(self._run, CACHE_PIECES)
        self.pieces = Kept(self._piece, CACHE_PIECES)

    def _run(self, run: str) -> bytes:
        level = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTE_LEVEL)
        return array("H", [t.id for t in self.model.tokenize(level)]).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        if piece.isalpha():
            return self.runs[piece.decode()]
        text = piece.decode()
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.runs.__getitem__, _RUNS.findall(text.lower())))
        return self._all(text)

    def _all(self, text: str) -> bytes:
        return array("H", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        """Ids of a text as 16-bit integers."""
        if not text:
            return b""
        lowered = text.encode().lower()
        if any(x in lowered for x in self.special):
            return self._all(text)
        return b"".join(map(self.pieces.__getitem__, lowered.split()))


# ---------------------------------------------------------------- Spark


def _put(folder: str, name: str, data: bytes) -> str:
    """Write a file so that it appears whole: a task that runs twice replaces it with the same bytes."""
    store, root = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    draft, final = f"{root}/.{name}.{uuid.uuid4().hex}", f"{root}/{name}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, final)
    return name


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, order: list[str | Column] | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into token files below ``folder``, in the given order, doc_id first by default.

    Returns one row per file: part, number, name, n_docs, n_tokens. Rows are range-partitioned by the order and sorted in
    their partition; ties follow the text. Each partition writes its files as it goes, so a task holds one file's ids.
    """
    prepare(docs.sparkSession)
    names = [f"_o{i}" for i in range(len(order or ["doc_id"]))]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(order or ["doc_id"], names, strict=True)])
    sort = [F.col(n).asc_nulls_first() for n in names]
    parts = keyed.repartitionByRange(*sort).sortWithinPartitions(*sort, F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    encoders: list[Encoder] = []

    def batches(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        counts: list[int] = []
        held = before = part = number = 0

        def file() -> pa.RecordBatch:
            # Part first: files in the order of their names are in the order of the documents.
            name = _put(folder, f"part-{part:06d}-{number:06d}.dac", encode_file(before, doc_ids, counts, np.frombuffer(b"".join(ids), "<u2")))
            row = [[part], [number], [name], [len(counts)], [sum(counts)]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["part", "number", "name", "n_docs", "n_tokens"])

        for batch in batches_in:
            if not encoders:
                encoders.append(Encoder(tokenizer_path))
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            for doc_id, own in zip(batch.column(0).to_pylist(), map(encoders[0], batch.column(1).to_pylist()), strict=True):
                ids += [own, struct.pack("<H", end_id)]
                doc_ids.append(doc_id)
                counts.append(len(own) // 2 + 1)
                held += counts[-1]
                if held >= FILE_TOKENS:
                    yield file()
                    ids, doc_ids, counts, held, before, number = [], [], [], 0, before + held, number + 1
        if counts:
            yield file()

    schema = "part int, number int, name string, n_docs long, n_tokens long"
    return barrier(parts.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(batches, schema), "token-files")


def read_tokens(spark, folder: str, files: DataFrame, work, schema: str, each: list[str]) -> DataFrame:
    """Read the files back: ``work(first place, TokenFile)`` gives the columns ``each`` of one file.

    A file knows its place in its part; the parts' places are one row per shuffle partition, a bound that the session sets.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder)
    part = F.regexp_extract("path", r"part-(\d+)-\d+\.dac$", 1).cast("int").alias("part")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row in range(batch.num_rows):
                file = TokenFile(batch.column(1)[row].as_py())
                yield pa.RecordBatch.from_arrays(work(batch.column(0)[row].as_py() + file.before, file), names=each)

    return content.select(part, "content").join(F.broadcast(parts), "part").select("before", "content").mapInArrow(batches, schema)


def _documents(first: int, file: TokenFile) -> list[pa.Array]:
    ids = memoryview(file.codes.stretch(0, len(file.codes)).astype("<u4")).cast("B")
    crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(file.starts[:-1], file.starts[1:], strict=True)]
    counts = np.diff(file.starts)
    return [pa.array(file.doc_ids, pa.int64()), pa.array(file.starts[:-1] + first), pa.array(counts), pa.array(crc, pa.int64())]


def token_digest(docs: DataFrame, tokenizer_path: str, folder: str, order: list[str | Column] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from the files that :func:`write_tokens` wrote.

    Null and empty texts have the end id alone. Rows with a null doc_id come first. Repeated rows are written again, in
    any order among themselves. Other columns are ignored. An empty table gives no files and no rows.
    """
    spark = prepare(docs.sparkSession)
    files = write_tokens(docs, tokenizer_path, folder, order)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files.take(1):
        return spark.createDataFrame([], schema)
    return read_tokens(spark, folder, files, _documents, schema, ["doc_id", "start", "n_tokens", "ids_crc32"])
