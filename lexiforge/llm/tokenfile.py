"""Token-ID output: Arrow stream files of fixed-size-list batches, with masks, and the index of the documents in them."""

from __future__ import annotations

import os
import uuid
from array import array
from collections.abc import Iterator
from urllib.parse import urlsplit
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.llm.common import Places, single_spaced, table
from lexiforge.store import materialize, shared_dir

_CACHED = 600_000
_PUNCTUATION = ".,!?;:"


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a Hadoop-style URI and the path in it; a bare path is local."""
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


class Encoder:
    """Texts to little-endian id bytes, equal to encoding each whole text at once.

    Byte-level BPE never merges over the edge before a single space or around a single line break between non-spaces, so
    a text is cut there and each distinct piece is encoded once while it is remembered (a fixed number of pieces). A text
    with other white space between its words, or with what may be a special token, is encoded whole.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype(kind)
        self.places, self.ids = Places(), []
        self.older: tuple[dict[str, int], list[bytes]] = ({}, [])
        self.marks = dict(zip(_PUNCTUATION, self._encode(list(_PUNCTUATION)), strict=True))
        self.line_break = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        code = {2: "H", 4: "I"}[self.kind.itemsize]
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str], run: int = 64) -> list[bytes]:
        """The ids of pieces that stand after a space: many are encoded as one text, with line breaks to cut its ids at."""
        if len(self.line_break) != self.kind.itemsize:
            return self._encode([" " + p for p in pieces])
        out, width = [], self.kind.itemsize
        mark = np.frombuffer(self.line_break, dtype=self.kind)[0]
        for ids in self._encode([" " + "\n ".join(pieces[i : i + run]) for i in range(0, len(pieces), run)]):
            cut = (np.flatnonzero(np.frombuffer(ids, dtype=self.kind) == mark) * width).tolist()
            out += [ids[a:b] for a, b in zip([0, *(c + width for c in cut)], [*cut, len(ids)], strict=True)]
        return out

    def _learn(self, new: list[str]) -> None:
        """The ids of new pieces, put after those known: a trailing mark after a letter and a line break before all else are
        pre-tokens of their own."""
        got: dict[str, bytes | None] = {}
        split = {}
        for p in new:
            if p[0] == "\n":
                got[p] = None
                continue
            if len(p) > 2 and p[-1] in _PUNCTUATION and p[-2].isalpha():
                split[p] = p[:-1]
                p = p[:-1]
            old = self.older[0].get(p)
            got[p] = None if old is None else self.older[1][old]
        lines = [p for p, ids in got.items() if ids is None and p[0] == "\n"]
        todo = [p for p, ids in got.items() if ids is None and p[0] != "\n"]
        got.update(zip(todo, self._encode_pieces(todo), strict=True))
        got.update(zip(lines, self._encode(lines), strict=True))
        self.ids += [got[p] if p not in split else got[split[p]] + self.marks[p[-1]] for p in new]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.places) > _CACHED:  # what is used again soon moves over, the rest is forgotten
            self.older, self.places, self.ids = (dict(self.places), self.ids), Places(), []
        cut = [None if "<|" in t else single_spaced(t) for t in texts]
        whole = [t if pieces is None else pieces[0] for t, pieces in zip(texts, cut, strict=True)]
        at = [None if pieces is None else list(map(self.places.__getitem__, pieces[1:])) for pieces in cut]
        if self.places.new:
            self._learn(self.places.new)
            self.places.new = []
        known = self.ids.__getitem__
        return [head if places is None else head + b"".join(map(known, places)) for head, places in zip(self._encode(whole), at, strict=True)]


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, kind: str) -> Encoder:
    """The encoder of this worker process, so that later tasks find its pieces."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


class _Writer:
    """One Arrow stream file: ids and mask as fixed-size lists of the same length, in batches of equal numbers of rows."""

    def __init__(self, uri: str, kind: str, length: int, rows: int):
        self.uri, self.kind, self.length, self.rows = uri, np.dtype(kind), length, rows
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        system, path = filesystem(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = system.open_output_stream(path)
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.held, self.size, self.total = [], 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids) // self.kind.itemsize
        if self.size >= (full := self.length * self.rows * self.kind.itemsize):
            data = b"".join(self.held)
            whole = len(data) // full * full
            for at in range(0, whole, full):
                self._batch(memoryview(data)[at : at + full])
            self.held, self.size = [data[whole:]], len(data) - whole

    def _batch(self, data: bytes | memoryview) -> None:
        ids = np.frombuffer(data, dtype=self.kind)
        n = -(-len(ids) // self.length) * self.length
        mask = np.arange(n) < len(ids)
        ids = np.concatenate([ids, np.zeros(n - len(ids), dtype=self.kind)])
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if self.size:
            self._batch(b"".join(self.held))
        self.out.close()
        self.sink.close()


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    text: str = "text",
    doc_id: str = "doc_id",
    *,
    end_id: int = 2,
    kind: str = "uint16",
    length: int = 2048,
    rows: int = 64,
    partition_bytes: int = 32 << 20,
) -> DataFrame:
    """Encode docs in ascending order of id into Arrow stream files; the index: rows (part, file, doc_id, first, n_tokens).

    Every document's ids, its end id last, follow those of the one before it; a file holds one range of ids as sequences of
    `length` ids with a mask that is false only on the padding of the file's last sequence. first counts ids from the
    file's start. Null texts are empty: their end id alone. Null ids come first; equal ids are ordered by a hash of the text, so
    that one id or none may hold most rows, and all rows are kept. Files are written under a name of their own attempt and only a task that ended is in the index, so a task
    may be run again at any time. Ranges follow the texts' bytes in total, about partition_bytes each.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", "mix", "spread"]  # a row that repeats has its place in the table besides
    spread = base.select("*", F.xxhash64("text").alias("mix"), F.monotonically_increasing_id().alias("spread"))
    ordered = spread.repartitionByRange(max(1, -(-size // partition_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, writer, uri = _encoder(tokenizer, kind), None, f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrows"
        end = np.array([end_id], dtype=kind).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                writer = writer or _Writer(uri, kind, length, rows)
                first, n = [], []
                for ids in encoder.encode(piece.column(1).to_pylist()):
                    first.append(writer.total)
                    writer.add(ids)
                    writer.add(end)
                    n.append(writer.total - first[-1])
                k = piece.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * k, pa.int32()), pa.array([uri] * k), piece.column(0), pa.array(first, pa.int64()), pa.array(n, pa.int64())],
                    ["part", "file", "doc_id", "first", "n_tokens"],
                )
        if writer:
            writer.close()

    kind_of_id = base.schema["doc_id"].dataType.simpleString()
    return materialize(ordered.mapInArrow(run, f"part int, file string, doc_id {kind_of_id}, first bigint, n_tokens bigint"), "token-index")


def open_sequences(uri: str) -> tuple[list[pa.RecordBatch], int]:
    """The batches of a file, mapped and not copied where it is local, and the rows of each but the last."""
    system, path = filesystem(uri)
    from pyarrow import fs

    source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
    batches = list(pa.ipc.open_stream(source))
    return batches, batches[0].num_rows if batches else 0


def read_ids(batches: list[pa.RecordBatch], per_batch: int, first: int, n: int) -> np.ndarray:
    """n ids from place `first` of a file on: views of the mapped batches, joined only where a document spans two."""
    length = batches[0].schema.field("ids").type.list_size
    step, parts = per_batch * length, []
    while n > 0:
        b, at = divmod(first, step)
        ids, mask = (batches[b].column(c).values for c in (0, 1))
        k = min(n, step - at)
        view = ids.slice(at, k).to_numpy()
        if len(view) < k or not mask.slice(at, k).true_count == k:
            raise ValueError(f"ids {first} to {first + k} are not in the file")
        parts.append(view)
        first, n = first + k, n - k
    return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, dtype=np.uint16)])


def read(index: DataFrame) -> DataFrame:
    """For each row of an index, read from its file: (doc_id, start, n_tokens, ids_crc32).

    start counts the ids of all documents before it, over all files in their order; ids_crc32 is taken over the ids as
    little-endian unsigned 32-bit integers. Files are dealt out by name, so each is opened by one task; its documents are
    read as views of the mapped file.
    """
    sums = materialize(index.groupBy("part", "file", F.floor(F.col("part") / 1024).alias("run")).agg(F.sum("n_tokens").alias("n")), "token-files")
    earlier = lambda by, n: F.sum(n).over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col(n)
    runs = sums.groupBy("run").agg(F.sum("n").alias("of_run")).select("run", earlier(W.orderBy("run"), "of_run").alias("runs_before"))  # one row a thousand files
    inside = earlier(W.partitionBy("run").orderBy("part"), "n")
    before = materialize(sums.select("part", "file", "run", inside.alias("inside")).join(runs, "run").select("part", "file", (F.col("runs_before") + F.col("inside")).alias("before")), "token-starts")
    rows = index.join(before, ["part", "file"]).select("file", "doc_id", (F.col("before") + F.col("first")).alias("start"), "first", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, at = None, ""
        for batch in batches:
            crc = np.zeros(batch.num_rows, dtype=np.int64)
            for i, (uri, first, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 3, 4)), strict=True)):
                if uri != at:
                    opened, at = open_sequences(uri), uri
                crc[i] = crc32(read_ids(*opened, first, n).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(4), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind_of_id = index.schema["doc_id"].dataType.simpleString()
    return rows.repartition("file").sortWithinPartitions("file", "first").mapInArrow(run, f"doc_id {kind_of_id}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op6_token_file(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/token-files/{uuid.uuid4().hex}"
    return read(write(table(spark, sf_dir, "documents"), folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op6_token_file": op6_token_file}
ORACLES: dict[str, str] = {}
