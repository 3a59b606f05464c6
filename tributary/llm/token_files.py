"""Token-id files: ids of all documents in one array, document boundaries in Elias-Fano form.

A file holds a run of documents in ascending key order:

    magic (8 bytes) | ids, little-endian, 2 or 4 bytes each | boundaries | keys | footer

Boundaries are the n + 1 offsets into the ids, keys the n document keys less
the first; both are Elias-Fano sequences: the low bits of each value packed
side by side, the high bits as a unary bit vector with a sample of where every
256th set bit is. ``select`` finds value i from the sample and at most a few
words after it, so no table of 64-bit offsets is kept or built.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tributary.llm.common import mounted, scratch_path, text_bytes, text_chunks

MAGIC = b"TRBIDS01"
SAMPLE = 256
CACHED_WORDS = 600_000
DOCUMENTS = 4096  # read together


class EliasFano:
    """A non-decreasing sequence of integers from 0 on, in about 2 + log2(largest / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        lows = (values & np.uint64((1 << bits) - 1))[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 1 if n else 0), dtype=np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(lows.astype(np.uint8).ravel(), bitorder="little"),
                   np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32 if n == 0 or ones[-1] < 1 << 32 else np.uint64))

    def select(self, i: int) -> int:
        """Value number i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        while True:
            bits = np.flatnonzero(np.unpackbits(self.high[byte:byte + 64], bitorder="little")[skip:])
            if left < len(bits):
                one = byte * 8 + skip + int(bits[left])
                break
            left, byte, skip = left - len(bits), byte + 64, 0
        return (one - i << self.low_bits) | self._low(i)

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        window = int.from_bytes(self.low[first // 8:(first + self.low_bits + 7) // 8].tobytes(), "little")
        return window >> first % 8 & ((1 << self.low_bits) - 1)

    def run(self, first: int, stop: int) -> np.ndarray:
        """Values first to stop - 1, selected together: from the sample before the first to the one after the last."""
        if not 0 <= first <= stop <= self.n:
            raise IndexError((first, stop))
        if first == stop:
            return np.zeros(0, dtype=np.uint64)
        after = (stop - 1) // SAMPLE + 1
        begin, end = int(self.samples[first // SAMPLE]), int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin // 8:end // 8 + 1], bitorder="little")) + begin // 8 * 8
        skip = int(np.searchsorted(ones, begin)) + first % SAMPLE
        i = np.arange(first, stop)
        values = (ones[skip:skip + stop - first] - i).astype(np.uint64) << np.uint64(self.low_bits)
        for bit in range(self.low_bits):
            where = i * self.low_bits + bit
            values |= (self.low[where // 8] >> (where % 8).astype(np.uint8) & 1).astype(np.uint64) << np.uint64(bit)
        return values

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]

    def shape(self) -> list:
        return [self.n, self.low_bits, len(self.low), len(self.high), len(self.samples), self.samples.dtype.str]

    @classmethod
    def read(cls, data: np.ndarray, at: int, shape: list) -> tuple[EliasFano, int]:
        n, bits, low, high, samples, kind = shape
        end = at + low + high + samples * np.dtype(kind).itemsize
        return cls(n, bits, data[at:at + low], data[at + low:at + low + high], np.frombuffer(data[at + low + high:end].tobytes(), dtype=kind)), end


class IdFile:
    """One file, memory-mapped."""

    def __init__(self, path: str):
        self.data = np.memmap(path, dtype=np.uint8, mode="r")
        size, = struct.unpack("<I", self.data[-12:-8].tobytes())
        if self.data[:8].tobytes() != MAGIC or self.data[-8:].tobytes() != MAGIC:
            raise ValueError(f"{path} is no whole id file")
        about = json.loads(self.data[-12 - size:-12].tobytes())
        ids_end = 8 + about["ids"] * about["width"]
        self.ids = self.data[8:ids_end].view(f"<u{about['width']}")
        self.null_keys, self.first_key = about["null_keys"], about["first_key"]
        self.bounds, at = EliasFano.read(self.data, ids_end, about["bounds"])
        self.keys, _ = EliasFano.read(self.data, at, about["keys"])

    def __len__(self) -> int:
        return self.bounds.n - 1

    def document(self, i: int) -> np.ndarray:
        """The ids of document i, its end id included."""
        return self.ids[self.bounds.select(i):self.bounds.select(i + 1)]


def write_file(path: str, rows: Iterable[tuple[list[int | None], list[bytes]]], width: int) -> tuple[int, int, int, int | None]:
    """Write runs of (keys, ids as bytes); (documents, ids, null keys, first key). A file appears whole or not at all."""
    sizes: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    nulls, first = 0, None
    partial = f"{path}.{uuid.uuid4().hex}"
    with open(partial, "wb") as out:
        out.write(MAGIC)
        for some, ids in rows:
            out.write(b"".join(ids))
            sizes.append(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // width)
            known = [k for k in some if k is not None]
            nulls += len(some) - len(known)
            if known:
                first = known[0] if first is None else first
                keys.append(np.fromiter((k - first for k in known), dtype=np.uint64, count=len(known)))
        bounds = np.cumsum(np.concatenate([np.zeros(1, dtype=np.int64), *sizes]))
        fences, names = EliasFano.of(bounds), EliasFano.of(np.concatenate([np.zeros(0, dtype=np.uint64), *keys]))
        about = json.dumps({"ids": int(bounds[-1]), "width": width, "null_keys": nulls, "first_key": first,
                            "bounds": fences.shape(), "keys": names.shape()}).encode()
        out.write(b"".join([*fences.parts(), *names.parts(), about, struct.pack("<I", len(about)), MAGIC]))
    os.replace(partial, path)
    return len(bounds) - 1, int(bounds[-1]), nulls, first


# The rules, as a vocabulary file states them, under which parts between white space can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
# The pattern that splits lower-case text in the vocabulary's file, with its letters and digits limited
# to ASCII, Latin-1 and Latin Extended-A. No character of these composes with another, and each has one lower-case form.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u0148\u014a-\u017f]+|[0-9]|[^\sa-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+")
PLAIN = re.compile(r"[\x21-\x7e\xa1\xbf\xc0-\u012f\u0131-\u0148\u014a-\u017e]+")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


_encoders: dict[tuple[str, int], tuple[Callable[[list[bytes]], list[bytes]], int]] = {}


class _Memory(dict):
    """Results by argument, worked out when first asked for; emptied when it is full."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[key] = self.make(key)
        return found


def _encoder(path: str, end_id: int) -> tuple[Callable[[list[bytes]], list[bytes]], int]:
    """(texts -> ids as little-endian bytes, bytes of an id); kept by a worker from task to task, its memories as long as the caller wants.

    The vocabulary's rules never look across ASCII white space: it is dropped,
    and neither its composition of characters nor its patterns span it. So ids
    of a text are the ids of its parts in order, and parts seen before are not
    encoded again. A new part of common Latin characters is split by the
    vocabulary's own pattern and its pieces go to the library's model, once
    each; any other part goes through the whole library. Both memories are
    emptied when they are full. All this holds for a vocabulary with the rules
    above; whole texts of any other go through the library.
    """
    from tokenizers import Tokenizer

    if (path, end_id) in _encoders:
        return _encoders[path, end_id]
    tokenizer = Tokenizer.from_file(path)
    width = 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    kind = np.dtype(f"<u{width}")
    last = np.array([end_id], dtype=kind).tobytes()
    tokenize, letters = tokenizer.model.tokenize, _byte_letters()
    special = any(not t.content.startswith("<|") for t in tokenizer.get_added_tokens_decoder().values())
    spelling = [i.to_bytes(width, "little") for i in range(tokenizer.get_vocab_size())]

    def ids_of_piece(text: str) -> bytes:
        spelled = text if text.isascii() else "".join(letters[b] for b in text.encode())
        return b"".join([spelling[t.id] for t in tokenize(spelled)])

    with open(path, encoding="utf-8") as file:
        stated = json.load(file)
    if (stated["normalizer"], stated["pre_tokenizer"], special) != (NORMALIZER, PRE_TOKENIZER, False):
        def whole(texts: list[bytes]) -> list[bytes]:
            found = tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(e.ids, dtype=kind).tobytes() + last for e in found]

        _encoders[path, end_id] = whole, width
        return _encoders[path, end_id]

    pieces = _Memory(ids_of_piece)
    piece = pieces.__getitem__

    def ids_of_part(part: bytes) -> bytes:
        text = part.decode()
        if b"<|" in part or not PLAIN.fullmatch(text):
            return b"".join([spelling[i] for i in tokenizer.encode(text, add_special_tokens=False).ids])
        text = text.lower()
        return piece(text) if text.isalpha() and text.isascii() else b"".join(map(piece, PIECES.findall(text)))

    parts = _Memory(ids_of_part)
    part = parts.__getitem__

    def encode(texts: list[bytes]) -> list[bytes]:
        return [b"".join([*map(part, t.split()), last]) for t in texts]

    def forget() -> None:
        parts.clear()

    encode.forget = forget

    _encoders[path, end_id] = encode, width
    return _encoders[path, end_id]


def write_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, files: int | None = None,
              key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and write id files in ascending key order; one row per file.

    (file, path, documents, n_ids, start): ``start`` counts the ids of all files
    before. Rows are dealt out by ranges of the key, further by text, so that a
    key that many rows share is split too; a null text is empty, null keys come
    first. Each file is written under a name of its own and renamed when whole,
    so a task that is run again replaces it. ``files`` is the number of shuffle
    partitions unless given. ``folder`` must be mounted on every machine; it is
    a new one in the shared folder unless given.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    into = mounted(folder or scratch_path(spark, "ids"))
    os.makedirs(into, exist_ok=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, width = _encoder(tokenizer, end_id)
        number = TaskContext.get().partitionId()
        path = os.path.join(into, f"{number:06d}.ids")
        n, ids, _, _ = write_file(path, ((part.column("_key").to_pylist(), encode(texts)) for part, texts in text_chunks(batches)), width)
        getattr(encode, "forget", int)()  # the worker outlives this stage
        yield pa.RecordBatch.from_pydict({"file": [number], "path": [path], "documents": [n], "n_ids": [ids]})

    rows = text_bytes(docs, F.col(f"`{key}`").cast("long").alias("_key"), F.xxhash64(text).alias("_hash"), text=text)
    rows = rows.repartitionByRange(files, F.asc_nulls_first("_key"), "_hash").sortWithinPartitions(F.asc_nulls_first("_key"), "_hash")
    made = sorted(tuple(r) for r in rows.mapInArrow(run, "file long, path string, documents long, n_ids long").collect())  # a row per file
    starts = [0, *accumulate(n_ids for _, _, _, n_ids in made)]
    return spark.createDataFrame([(*r, start) for r, start in zip(made, starts)], "file long, path string, documents long, n_ids long, start long")


def read_ids(listed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) per document, from the files that ``write_ids`` listed.

    start: ids of all documents before; n_tokens: with the end id; ids_crc32:
    unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, documents in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "documents"))):
                if documents:
                    yield from rows(IdFile(path), start)

    def rows(file: IdFile, start: int) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(file), DOCUMENTS):
            stop = min(first + DOCUMENTS, len(file))
            bounds = file.bounds.run(first, stop + 1).astype(np.int64)
            named = file.keys.run(max(0, first - file.null_keys), max(0, stop - file.null_keys)).astype(np.int64)
            keys = [None] * (stop - first - len(named)) + [k + file.first_key for k in named.tolist()]
            crc = [zlib.crc32(file.ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_pydict({
                "_key": pa.array(keys, pa.int64()), "start": pa.array(bounds[:-1] + start, pa.int64()),
                "n_tokens": pa.array(np.diff(bounds), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    # A fixed number of parts: the list is short, so that adaptive execution would join them into one task that reads every file.
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = listed.filter("documents > 0").select("path", "start", "documents").repartition(parts, "path")
    return listed.mapInArrow(run, "_key long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("_key", key)


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as id files and give what the files say of each document.

    Every row gives a row; of rows with one key the order is that of their
    texts' hashes. An empty table gives an empty result. Keys are integers.
    """
    return read_ids(write_ids(docs, tokenizer, end_id=end_id, key=key, text=text), key)
