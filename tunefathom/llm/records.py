"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A record file holds one record after the other, in ascending key order::

    uint64 payload length | uint32 masked CRC of those 8 bytes | payload | uint32 masked CRC of the payload

    payload: uint8 key present | int64 key | uint8 id width (2 or 4) | ids, little endian

The checksum is CRC-32, rotated right by 15 bits plus a constant, so that a file of checksums does not check itself.
The index file beside it has one entry per record (key present, key, offset, payload length, number of ids) and a
masked CRC at its end.

Ids are written by one task per key range, in files of bounded size. A task writes under a name of its own attempt, and only the attempts
that Spark commits are listed in the manifest, a Parquet table beside the files: a lost or repeated task leaves
unlisted files behind and nothing else. Nothing but the manifest's few rows per file meets in one task.

Defined results: a null text has no ids but the end id, a null key sorts first and is read back as null, equal keys
stay separate records (ordered by text), an empty table gives an empty manifest and no records. The key and text
columns are chosen by name; other columns are not written.
"""

from __future__ import annotations

import itertools
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tunefathom.llm.bpe import _Numbered, text_slices
from tunefathom.session import work_path

MASK_DELTA = 0xA282EAD8
INDEX_ENTRY = np.dtype([("known", "u1"), ("key", "<i8"), ("offset", "<u8"), ("size", "<u8"), ("n", "<u8")])
#: Bytes of neighbouring records fetched at once while reading.
READ_BYTES = 8_000_000
CACHED_PIECES = 600_000
#: Bytes from which a task begins a new file, and index entries that are packed together.
FILE_BYTES, PACKED = 512_000_000, 4096


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


class _Ids:
    """Rows of ids in one flat array that doubles when it is full."""

    def __init__(self) -> None:
        self.flat, self.ends, self.rows = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        start, rows = int(self.ends[self.rows]), self.rows + len(lengths)
        while start + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while rows + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.empty_like(self.ends)])
        self.flat[start:start + len(flat)] = flat
        self.ends[self.rows + 1:rows + 1] = start + np.cumsum(lengths)
        self.rows = rows

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the rows in order, and each row's length."""
        starts = self.ends[rows]
        lengths = self.ends[rows + 1] - starts
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


class PieceEncoder:
    """The tokenizers library on whole texts, encoding every piece between single spaces or line breaks once.

    A byte-level pre-tokenizer always begins a word at a space before a character, and a line break between two
    characters stands alone. Texts in which two white-space characters meet go to the library whole. New pieces go there
    joined by line breaks, whose id then tells them apart; pieces with white space inside or special tokens go alone.
    Texts are cut and equal pieces of a batch found in Arrow, so that Python sees each of them once a batch. Symbols
    after a letter or digit begin a word of their own, so pieces are kept without the symbols at their ends.
    """

    #: Two white-space characters in a row, as Unicode has them, or the mark between pieces.
    _WHOLE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}|\x01"
    _TOGETHER = 256
    #: Letters and digits that every Unicode version has, and symbols that a word's last letter never goes with.
    _SOLID = frozenset(c for c in map(chr, range(0x250)) if c.isalnum())
    _ENDS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([r"(?!^ \S)[^\S\n]", *map(re.escape, special)]), re.MULTILINE)
        self.ends = "".join(c for c in self._ENDS if not any(c in token for token in special))
        line = self._encode(["\n"])[0]
        self.line = line[0] if len(line) == 1 else None
        self._reset()

    def _reset(self) -> None:
        self.pieces, self.ids = _Numbered(), _Ids()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self._encode(pieces)]

    def _learn(self, fresh: list[str]) -> None:
        """Encode new pieces and keep them in the order of their numbers."""
        groups = [fresh[i:i + self._TOGETHER] for i in range(0, len(fresh), self._TOGETHER)]
        texts = ["\n".join(group) for group in groups]
        together = [self.line is not None and not self.odd.search(text) for text in texts]
        found = iter(self._alone([text for text, fits in zip(texts, together) if fits]))
        for group, fits in zip(groups, together):
            ids = next(found) if fits else None
            lines = np.flatnonzero(ids == self.line) if fits else None
            if fits and len(lines) == len(group) - 1:
                self.ids.append(ids[ids != self.line], np.diff(np.concatenate([[-1], lines, [len(ids)]])) - 1)
            else:  # a piece with white space inside, a special token or a line break
                parts = self._alone(group)
                self.ids.append(np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts)))

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        if len(self.pieces) > CACHED_PIECES:
            self._reset()
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        whole = pc.fill_null(pc.match_substring_regex(texts, self._WHOLE), False)
        cut = pc.if_else(whole, "", pc.fill_null(texts, ""))
        cut = pc.replace_substring(pc.replace_substring(cut, " ", "\x01 "), "\n", "\x01\n\x01")
        cut = pc.split_pattern(cut, "\x01")
        found = cut.flatten().dictionary_encode()
        pieces = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        stems = [stem if stem[-1:] in self._SOLID else piece for piece, stem in zip(pieces, (piece.rstrip(self.ends) for piece in pieces))]
        parts = [stems, [piece[len(stem):] for piece, stem in zip(pieces, stems)]]
        numbers = np.fromiter(map(self.pieces.__getitem__, itertools.chain(*parts)), np.int64, 2 * len(pieces))
        fresh, self.pieces.fresh = self.pieces.fresh, []
        if fresh:
            self._learn(fresh)
        flat, lengths = self.ids.take(numbers.reshape(2, -1).T.ravel())
        own = _Ids()  # of the batch's pieces
        own.append(flat, lengths[::2] + lengths[1::2])
        flat, lengths = own.take(found.indices.to_numpy())
        ends = np.append(0, np.cumsum(lengths))
        upto = ends[np.append(0, np.cumsum(cut.value_lengths().to_numpy()))].tolist()
        out = [flat[a:b] for a, b in zip(upto, upto[1:])]
        rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        for i, ids in zip(rows, self._encode(texts.take(pa.array(rows)).to_pylist())):
            out[i] = np.array(ids, dtype=np.int32)
        return out


class RecordWriter:
    """Writes one record file and its index."""

    def __init__(self, folder: str, name: str) -> None:
        self.store, self.base = fs.FileSystem.from_uri(f"{folder}/{name}")
        self.store.create_dir(os.path.dirname(self.base), recursive=True)
        self.file, self.offset, self.records, self.total = self.store.open_output_stream(self.base + ".rec"), 0, 0, 0
        self.entries, self.index = [], []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
        payload = b"".join([bytes([key is not None]), np.int64(key or 0).tobytes(), bytes([width]), ids.astype(f"<u{width}").tobytes()])
        size = np.uint64(len(payload)).tobytes()
        self.file.write(b"".join([size, np.uint32(masked_crc(size)).tobytes(), payload, np.uint32(masked_crc(payload)).tobytes()]))
        self.entries.append((key is not None, key or 0, self.offset, len(payload), len(ids)))
        if len(self.entries) == PACKED:
            self._pack()
        self.offset += len(payload) + 16
        self.records, self.total = self.records + 1, self.total + len(ids)

    def _pack(self) -> None:
        self.index.append(np.array(self.entries, dtype=INDEX_ENTRY).tobytes())
        self.entries = []

    def close(self) -> None:
        self.file.close()
        self._pack()
        index = b"".join(self.index)
        with self.store.open_output_stream(self.base + ".idx") as out:
            out.write(index + np.uint32(masked_crc(index)).tobytes())


def read_index(folder: str, name: str) -> np.ndarray:
    """The entries of a record file, in file order; any of them can be read on its own."""
    store, base = fs.FileSystem.from_uri(f"{folder}/{name}")
    with store.open_input_file(base + ".idx") as file:
        data = file.read()
    if np.uint32(masked_crc(data[:-4])).tobytes() != data[-4:]:
        raise ValueError(f"{name}.idx is damaged")
    return np.frombuffer(data[:-4], dtype=INDEX_ENTRY)


def read_records(folder: str, name: str, entries: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """Key and ids of the records at ``entries`` (any choice and order of a file's index), checked."""
    store, base = fs.FileSystem.from_uri(f"{folder}/{name}")
    with store.open_input_file(base + ".rec") as file:
        start = 0
        while start < len(entries):
            # neighbouring records come in one read
            end, low = start + 1, int(entries[start]["offset"])
            high = low + int(entries[start]["size"]) + 16
            while end < len(entries) and int(entries[end]["offset"]) == high and high - low < READ_BYTES:
                high += int(entries[end]["size"]) + 16
                end += 1
            data = file.read_at(high - low, low)
            for entry in entries[start:end]:
                at, size = int(entry["offset"]) - low, int(entry["size"])
                head, payload, tail = data[at:at + 12], data[at + 12:at + 12 + size], data[at + 12 + size:at + 16 + size]
                if head != np.uint64(size).tobytes() + np.uint32(masked_crc(head[:8])).tobytes() or tail != np.uint32(masked_crc(payload)).tobytes():
                    raise ValueError(f"a record of {name}.rec is damaged")
                key = int(np.frombuffer(payload, "<i8", 1, 1)[0]) if payload[0] else None
                yield key, np.frombuffer(payload, f"<u{payload[9]}", offset=10)
            start = end


_ENCODERS: dict[int, PieceEncoder] = {}


def _encoder(spec: str) -> PieceEncoder:
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(spec)
    return _ENCODERS[key]


def write_token_records(docs: DataFrame, vocabulary_path: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text", files: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode ``text`` and write it to record files below ``folder`` in ascending ``key`` order; returns the manifest.

    One row per file: name, number of records and ids. ``files`` key ranges (the session's shuffle partitions unless
    given) are written by a task each, which begins a new file every ``file_bytes``.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())  # a vocabulary file: a few MB, whatever the corpus
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, writer, first = uuid.uuid4().hex, 0, None, None

        def finished() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pylist([{"first_key": first, "name": name, "n_records": writer.records, "n_tokens": writer.total}], schema=manifest_schema)
        for batch in text_slices(batches, "text"):
            for k, ids in zip(batch.column("key").to_pylist(), _encoder(spec.value).encode(batch.column("text"))):
                if writer is not None and writer.offset >= file_bytes:
                    yield finished()
                    writer = None
                if writer is None:
                    # files of one task follow each other by name, also where they begin with equal keys
                    name, number, first = f"tokens-{task}-{number:06d}", number + 1, k
                    writer = RecordWriter(folder, name)
                writer.add(k, np.append(ids, end_id))
        if writer is not None:
            yield finished()

    manifest_schema = pa.schema([("first_key", pa.int64()), ("name", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64())])
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(files, "key").sortWithinPartitions("key", "text")
    manifest = ordered.mapInArrow(work, "first_key long, name string, n_records long, n_tokens long")
    manifest.write.parquet(f"{folder}/manifest")  # the commit: names of the finished attempts
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The committed files in key order, with the number of ids in all files before each."""
    files = spark.read.schema("first_key long, name string, n_records long, n_tokens long").parquet(f"{folder}/manifest")
    before = Window.orderBy(F.asc_nulls_first("first_key"), "name").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_records(manifest: DataFrame, folder: str, schema: str, row: Callable[[int | None, np.ndarray, int], dict]) -> DataFrame:
    """``row(key, ids, start)`` of every record; ``start`` counts the ids of all records before it. One task per file at least."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                found, size = [], 0
                for key, ids in read_records(folder, name, read_index(folder, name)):
                    found.append(row(key, ids, start))
                    start, size = start + len(ids), size + len(ids)
                    if size > 1_000_000:
                        yield pa.RecordBatch.from_pylist(found, schema=arrow)
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)

    dealt = manifest.select("name", "start").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")
    return dealt.mapInArrow(work, schema)


def digest(key: int | None, ids: np.ndarray, start: int) -> dict:
    return {"doc_id": key, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def round_trip(docs: DataFrame, vocabulary_path: str, end_id: int) -> DataFrame:
    """Write all documents to a new folder of the shared file system and return one digest per record read back."""
    folder = work_path(docs.sparkSession, "token-records")
    manifest = write_token_records(docs, vocabulary_path, end_id, folder)
    return read_token_records(manifest, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", digest)
