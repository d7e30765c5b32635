"""Token-ID output: independent zstandard frames, a trailing seek table and per-frame checksums.

A file is a run of frames, each with whole documents: a count, then for every document its id, number of ids and place,
then all their ids as little-endian unsigned 32-bit integers. The frames are followed by a skippable frame with the first doc_id of each
frame, and by the seek table of the public zstd seekable format (sizes and the low half of XXH64 of every frame's
content). A reader takes the table from the file's end and opens only the frames that hold the ids it's asked for.

Documents are dealt out by ranges of doc_id and written in ascending order (null ids first, ties by text), one file
for each range, under a name that only depends on the range: a repeated task writes the same file again. Null texts
count as empty, so they are just the end id. Repeated rows are written each. Other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, slices

FRAME_IDS = 1 << 18
_SKIP, _TABLE_MAGIC, _INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
_NO_ID = -(1 << 63)
MEMO = 1_000_000


#: Letters, numbers and white space below U+0100, for the standard library's faster patterns.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_LATIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


class _Places(dict):
    """Pre-token to its number; one that is missing gets the next number and joins the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        self.new.append(w)
        return n


class Encoder:
    """Ids of texts by the tokenizers library; ids of pre-tokens are remembered in one array, new ones are encoded in one call."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.find_latin = re.compile(_LATIN).findall
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        # The pattern is applied here; what is handed over are pre-tokens, joined by line ends.
        self.tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        (self.line_id,) = self._ids(self.tok, "\n")
        self._forget()

    @staticmethod
    def _ids(tok, text: str) -> list[int]:
        return tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _forget(self) -> None:
        self.memo = _Places()
        self.first = np.empty(0, np.int64)  # where a pre-token's ids begin in flat, and how many they are
        self.size = np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _learn(self, new: list[str]) -> None:
        flat, size, total = [self.flat], np.empty(len(new), np.int64), len(self.flat)
        first = np.empty(len(new), np.int64)
        lines = [i for i, w in enumerate(new) if "\n" in w]
        plain = np.setdiff1d(np.arange(len(new)), lines)
        for at in range(0, len(plain), 4096):
            places = plain[at : at + 4096]
            ids = np.array(self._ids(self.tok, "\n".join([new[i] for i in places.tolist()])), np.uint32)
            line = ids == self.line_id
            cuts = np.flatnonzero(line)
            if len(cuts) != len(places) - 1:
                raise ValueError("pre-tokens and ids don't match")
            flat.append(ids[~line])
            n = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
            size[places], first[places] = n, total + np.cumsum(n) - n
            total += len(flat[-1])
        for i in lines:
            flat.append(np.array(self._ids(self.whole, new[i]), np.uint32))
            size[i], first[i] = len(flat[-1]), total
            total += len(flat[-1])
        self.flat, self.first, self.size = np.concatenate(flat), np.concatenate([self.first, first]), np.concatenate([self.size, size])

    def pre_tokens(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find(text)
        return self.find_latin(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [self.pre_tokens(t) for t in texts]
        if len(self.memo) > MEMO:
            self._forget()
        k = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        if self.memo.new:
            self._learn(self.memo.new)
            self.memo.new = []
        n = self.size[k]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.first[k] - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])].tolist()
        return [ids[x:y] for x, y in zip(cuts, cuts[1:])]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Writer:
    """Writes documents, given in order, to one file; close() adds the index and the seek table."""

    def __init__(self, out, frame_ids: int = FRAME_IDS):
        self.out, self.frame_ids = out, frame_ids
        self.ids: list[int] = []
        self.lots: list[np.ndarray] = []
        self.held = 0
        self.table: list[tuple[int, int, int]] = []
        self.first: list[int] = []
        self.z = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(_NO_ID if doc_id is None else doc_id)
        self.lots.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_ids:
            self._flush()

    def _flush(self) -> None:
        if not self.ids:
            return
        n = np.array([len(x) for x in self.lots], np.int64)
        raw = struct.pack("<Q", len(n)) + np.array(self.ids, "<i8").tobytes() + n.astype("<i8").tobytes() + np.concatenate(self.lots).astype("<u4").tobytes()
        frame = self.z.compress(raw)
        self.out.write(frame)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.first.append(self.ids[0])
        self.ids, self.lots, self.held = [], [], 0

    def close(self) -> None:
        self._flush()
        index = np.array(self.first, "<i8").tobytes()
        self.out.write(struct.pack("<II", _INDEX_MAGIC, len(index)) + index)
        rows = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<III", 8 + len(index), 0, 0)
        foot = struct.pack("<IBI", len(self.table) + 1, 0x80, _TABLE_MAGIC)
        self.out.write(struct.pack("<II", _SKIP, len(rows) + len(foot)) + rows + foot)


class Reader:
    """Reads from a file that can seek. Frames are opened one at a time, and only those asked for."""

    def __init__(self, f, size: int):
        self.f = f
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _TABLE_MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        table = [struct.unpack_from("<III", self._at(size - 9 - 12 * n, 12 * n), 12 * i) for i in range(n)]
        at = [0, *accumulate(x[0] for x in table)]
        self.frames = [(a, c, d, s) for a, (c, d, s) in zip(at, table[:-1])]
        self.first = np.frombuffer(self._at(at[n - 1] + 8, table[-1][0] - 8), "<i8")
        self.opened = 0

    def _at(self, place: int, n: int) -> bytes:
        self.f.seek(place)
        return self.f.read(n)

    def frame(self, i: int) -> Iterator[tuple[int | None, np.ndarray]]:
        at, size, full, check = self.frames[i]
        raw = zstandard.ZstdDecompressor().decompress(self._at(at, size), max_output_size=full)
        self.opened += 1
        if len(raw) != full or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        (n,) = struct.unpack_from("<Q", raw)
        doc_ids, sizes = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
        ids, start = np.frombuffer(raw, "<u4", -1, 8 + 16 * n), 0
        for d, k in zip(doc_ids.tolist(), sizes.tolist()):
            yield (None if d == _NO_ID else d), ids[start : start + k]
            start += k

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.frames)):
            yield from self.frame(i)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document with that id, decompressing only the frames that can hold it."""
        lo = max(0, int(np.searchsorted(self.first, doc_id, "left")) - 1)
        hi = int(np.searchsorted(self.first, doc_id, "right"))
        return [x for i in range(lo, hi) for d, x in self.frame(i) if d == doc_id]


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there; Hadoop's names for S3 (s3a, s3n) are its usual one."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def write(docs: DataFrame, path: str, out: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Encodes and writes docs under the folder `out`; one row for each file: part, file, n_docs, n_ids."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, enc = task.partitionId(), encoder(path)
        fs, folder = file_system(out)
        name = f"part-{part:06d}.ids.zst"
        temp = f"{folder}/{name}.{task.taskAttemptId()}"
        n_docs = n_ids = 0
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(temp) as f:
            w, end = Writer(f), np.array([end_id], np.uint32)
            for b in slices(batches):
                for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                    w.add(d, np.concatenate([ids, end]))
                    n_docs, n_ids = n_docs + 1, n_ids + len(ids) + 1
            w.close()
        fs.move(temp, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]}, pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return dealt.mapInArrow(run, "part int, file string, n_docs long, n_ids long")


def read(spark, out: str, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; files: (name, ids in all files before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(out)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                size = fs.get_file_info(f"{folder}/{name}").size
                with fs.open_input_file(f"{folder}/{name}") as f:
                    r = Reader(f, size)
                    for i in range(len(r.frames)):
                        got: dict = {k: [] for k in schema.names}
                        for d, ids in r.frame(i):
                            for k, v in zip(schema.names, (d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                                got[k].append(v)
                            start += len(ids)
                        yield pa.RecordBatch.from_pydict(got, schema)

    listed = spark.createDataFrame(files or [("", 0)], "file string, start long").where(F.col("file") != "")
    return listed.repartition(max(1, len(files)), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    """Writes the files under `out` (by default a new folder in the shared one) and returns what read() finds there."""
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    done = sorted((r.part, r.file, r.n_ids) for r in write(docs, path, out, end_id).collect())  # a row for each file
    starts = [0, *accumulate(n for _, _, n in done)]
    return read(spark, out, [(f, s) for (_, f, n), s in zip(done, starts) if n])
