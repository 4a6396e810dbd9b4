"""Token ids as Arrow IPC files of equal-length sequences.

Documents are range-sorted by id; each task encodes its range with the tokenizers library and
packs all ids, end ids included, one after the other into sequences of one length. A file holds
fixed-size-list columns `ids` (the narrowest unsigned integers that hold the vocabulary) and
`mask` (bits; false only behind a file's last id), in batches of equal numbers of rows, so that
sequence i of a file lies in batch i // rows at row i % rows: a memory-mapped file gives it
without a copy. A second file lists the documents' places. The manifest has a row for each range.

A white-space-separated piece of text is encoded once and kept in the task's dictionary: the
vocabulary's normaliser drops white space and its pattern never spans it, so the pieces' ids
joined are the whole text's. (Pieces are parted at ASCII blanks only. New pieces of ASCII alone are
lowered first, which the normaliser does anyway; not those with "<|", which may spell a special
token, nor others, as the normaliser composes marks before it lowers. Of words that the normaliser
makes Latin letters, single matches of the pattern, the library's model is asked directly.)

A special token that a text spells gets its own id, as the library's encode() gives it.

File names hold the task attempt, and only accepted attempts are in the manifest. Cases: a null
or empty text has the end id only; null ids come first; rows with equal ids are ordered by the
text's hash; an empty table gives no file and no row; other columns aren't looked at.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.llm.bpe import slices
from panelflow.llm.common import shared_dir, tasks_for, written

LENGTH = 1024
BATCH_ROWS = 256
KEEP_PIECES = 1_000_000
BLANKS = bytes.maketrans(b"\t\n\r\v\f", b"     ")


#: Latin letters only: one match of the vocabulary's pattern, so its model can be asked directly.
WORD = re.compile("[a-zß-öø-ɏ]+").fullmatch


class Encoder:
    """A worker's tokenizer, with the pieces it has met.

    spell_special: whether special tokens in a text are taken as plain text; the library's own setting is False.
    """

    def __init__(self, spec: str, spell_special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = spell_special
        self.model, self.normal = self.tokenizer.model, self.tokenizer.normalizer.normalize_str
        # the characters that stand for bytes, as the library writes them
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {ord(x): "".join(t for t, _ in level.pre_tokenize_str(x)) for x in map(chr, range(0xDF, 0x250))}
        self.clear()

    def ids(self, text: str) -> list[int]:
        word = text if text.isascii() else self.normal(text)
        if WORD(word):
            return [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.spelled))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.code: dict[bytes, int] = {b"": 0}
        self.flat, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, new: list[bytes]) -> None:
        """Words with one mark behind them are put together of the word's ids and the mark's.

        Not so where the word isn't Latin letters once normalised: it may then end in a mark itself
        ("\u0130" becomes "i" and U+0307), which the pattern takes together with the one behind it.
        """
        plain = lambda word: word.isalpha() and (word.isascii() or WORD(self.normal(word)))
        texts = [(p.lower() if p.isascii() and b"<|" not in p else p).decode() for p in new]
        split = [(t[:-1], t[-1]) if t[-1] in ".,;:!?" and plain(t[:-1]) else (t, "") for t in texts]
        parts = list(dict.fromkeys(x for pair in split for x in pair if x))
        found = [self.ids(x) for x in parts]
        counts = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter(chain.from_iterable(found), np.uint32, counts.sum())
        number = dict(zip(parts, range(len(parts)), strict=True)) | {"": len(parts)}
        counts = np.append(counts, 0)
        start = np.cumsum(counts) - counts
        of = np.array([number[x] for pair in split for x in pair])
        n = counts[of]
        ends = np.concatenate([[0], np.cumsum(n)])
        own = flat[np.repeat(start[of] - ends[:-1], n) + np.arange(ends[-1])]
        size = n.reshape(-1, 2).sum(1)
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(size) - size])
        self.counts = np.concatenate([self.counts, size])
        self.flat = np.concatenate([self.flat, own])

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id; each text's number of ids."""
        pieces = [x.encode().translate(BLANKS).split(b" ") for x in texts]
        if len(self.code) > KEEP_PIECES:
            self.clear()
        sizes = np.array([len(ps) for ps in pieces])
        every = list(chain.from_iterable(pieces))
        codes = np.fromiter(map(self.code.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            lacking = [every[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(lacking)))
            codes[missing] = np.fromiter(map(self.code.__getitem__, lacking), np.int64, len(lacking))
        n = self.counts[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.starts[codes] - ends[:-1], n) + np.arange(ends[-1])]
        stop = ends[np.cumsum(sizes)]
        return np.insert(ids, stop, end), np.diff(stop, prepend=0) + 1


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(spec: str) -> Encoder:
    """This Python worker's encoder; a worker keeps its dictionary from task to task."""
    if hash(spec) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[hash(spec)] = Encoder(spec, spell_special=False)
    return _ENCODERS[hash(spec)]


class Packer:
    """A file of equal-length sequences, filled id by id."""

    def __init__(self, files: pafs.FileSystem, path: str, kind: pa.DataType, length: int):
        self.kind, self.length, self.rest = kind, length, np.zeros(0, kind.to_pandas_dtype())
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = files.open_output_stream(path, compression=None)
        self.out = pa.ipc.new_file(self.sink, self.schema)

    def put(self, rows: int, ids: np.ndarray, real: int) -> None:
        mask = np.arange(rows * self.length) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        held, step = np.concatenate([self.rest, ids.astype(self.rest.dtype)]), BATCH_ROWS * self.length
        whole = len(held) // step * step
        for at in range(0, whole, step):
            self.put(BATCH_ROWS, held[at : at + step], step)
        self.rest = held[whole:]

    def close(self) -> None:
        if len(self.rest):
            rows = -(-len(self.rest) // self.length)
            self.put(rows, np.pad(self.rest, (0, rows * self.length - len(self.rest))), len(self.rest))
        self.out.close()
        self.sink.close()


def check_spec(spec: str) -> None:
    """Raises ValueError unless the vocabulary encodes a text as it does its pieces between blanks.

    Probes: letters of several scripts, digits, marks, contractions, symbols and special tokens,
    each beside each, over each blank, at a text's ends and doubled.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    added = [t["content"] for t in json.loads(spec).get("added_tokens") or ()]
    pieces = ["a", "Word", "don't", "'s", "12", "7", ".", ",!", "é", "漢字", "\U0001f642", "\u0301", "_", "x9", *added]
    own = {p: ids(p) for p in pieces}
    texts = [(a, f"{a}{blank}{b}", b) for blank in (" ", "\t", "\n", "\r\n", "  ", "\v", "\f") for a in pieces for b in pieces] + [("", f" {a}\n", a) for a in pieces]
    for a, text, b in texts:
        if ids(text) != (own[a] if a else []) + own[b]:
            raise ValueError(f"this vocabulary's tokens reach over blanks ({text!r}): its texts can't be encoded piece by piece")


def write_files(df: DataFrame, spec: str, end: int, folder: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The manifest (part, ids_path, docs_path, docs, tokens): ranges of ascending ids, in the order of part.

    spec must pass check_spec(): ValueError otherwise.
    """
    check_spec(spec)
    shared = df.sparkSession.sparkContext.broadcast(spec)
    kind = pa.uint16() if max(max(json.loads(spec)["model"]["vocab"].values()), end) < 1 << 16 else pa.uint32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = encoder_of(shared.value), TaskContext.get()
        files, base = pafs.FileSystem.from_uri(folder)
        name = f"{base}/{{}}-{context.partitionId():06d}-{context.taskAttemptId()}.arrow"
        packer = places = sink = None
        docs = tokens = 0
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                if packer is None:
                    packer = Packer(files, name.format("ids"), kind, length)
                    sink = files.open_output_stream(name.format("docs"), compression=None)
                    schema = pa.schema([(id_col, batch.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                    places = pa.ipc.new_file(sink, schema)
                ids, counts = encoder.encode(texts, end)
                packer.add(ids)
                starts = tokens + np.cumsum(counts) - counts
                places.write_batch(pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(starts), pa.array(counts)], schema=schema))
                docs, tokens = docs + len(texts), tokens + len(ids)
        if packer is not None:
            packer.close()
            places.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([name.format("ids")]), pa.array([name.format("docs")]), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())], names=["part", "ids_path", "docs_path", "docs", "tokens"])

    rows = df.select(id_col, text_col)
    tie = F.xxhash64(text_col)
    rows = rows.repartitionByRange(tasks_for(df.sparkSession), F.col(id_col).asc_nulls_first(), tie).sortWithinPartitions(F.col(id_col).asc_nulls_first(), tie)
    return rows.mapInArrow(run, "part int, ids_path string, docs_path string, docs long, tokens long")


def open_file(uri: str, path: str):
    """A file of the folder for random access, memory-mapped where it is local."""
    files, _ = pafs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(files, pafs.LocalFileSystem) else files.open_input_file(path)


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence i of a file, and its mask; the ids aren't copied."""
    batch = reader.get_batch(i // BATCH_ROWS)
    row = i % BATCH_ROWS
    return batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values.to_numpy(zero_copy_only=False)


def flat(reader: pa.ipc.RecordBatchFileReader) -> Iterator[np.ndarray]:
    """The real ids of a file, batch by batch."""
    for i in range(reader.num_record_batches):
        batch = reader.get_batch(i)
        ids = batch.column(0).flatten().to_numpy()
        if i == reader.num_record_batches - 1:
            ids = ids[: batch.column(1).flatten().to_numpy(zero_copy_only=False).sum()]
        yield ids


def read_files(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from its files; start counts all ids before it."""
    # one row for each range: as many as the write had tasks
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = manifest.select("part", "ids_path", "docs_path", F.coalesce(before, F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(folder, row["ids_path"]) as ids_file, open_file(folder, row["docs_path"]) as docs_file:
                    pieces, held = flat(pa.ipc.open_file(ids_file)), np.zeros(0, np.uint32)
                    docs = pa.ipc.open_file(docs_file)
                    for i in range(docs.num_record_batches):
                        part = docs.get_batch(i)
                        counts = part.column(2).to_numpy()
                        got, need = [held], int(counts.sum()) - len(held)
                        while need > 0:
                            got.append(next(pieces).astype("<u4"))
                            need -= len(got[-1])
                        held = np.concatenate(got)
                        ends = np.cumsum(counts)
                        data = memoryview(held).cast("B")
                        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                        held = held[int(ends[-1]) :]
                        start = pa.array(part.column(1).to_numpy() + row["before"])
                        yield pa.RecordBatch.from_arrays([part.column(0), start, part.column(2), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    parts = parts.repartition(tasks_for(manifest.sparkSession), "part")
    return parts.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, spec: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's place and ids' checksum, as read back from the files."""
    folder = shared_dir(df.sparkSession)
    manifest = written(write_files(df, spec, end, folder, id_col=id_col, text_col=text_col), folder, "manifest")
    return read_files(manifest, folder, id_col)


def public_spec(name: str = "word_bpe_49k.json") -> str:
    """The installed public vocabulary's file; its size is fixed (under 2 MB)."""
    import public_tokenizers

    with open(public_tokenizers.path(name)) as f:
        return f.read()
