"""Token ids as binary files of byte or bit planes.

Documents are range partitioned and sorted by doc_id; each task tokenises its part
and writes one file.  Ids are cut into blocks of ``BLOCK_IDS``.  A block is transposed
into planes (all lowest bytes, all second bytes, ... or all lowest bits, ...), each
plane is compressed with zstandard by itself, and an all-zero plane takes no
bytes.  The footer holds the chunk index: offset, number of ids and plane sizes of
each block, so a reader can go to any block.

File: MAGIC, planes of all blocks, doc ids, lengths, footer (JSON), footer size
(8 bytes, little endian), MAGIC.

A file gets a name of its own for each attempt of a task, and only files named in
the manifest, which Spark commits after all tasks have ended, are part of the data
set: a lost or repeated task leaves at most a file that nobody reads.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loadlens.functions.lineage import scratch_folder
from loadlens.llm.common import ship, small_batches

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
LEVEL = 3
END_ID = 2
#: Bytes that a reader hands on together.
READ_BYTES = 8 << 20
#: Ids of so many pieces of text are kept by a Python worker, in each of two generations.  A worker keeps them while it
#: does other work, too, so they count in the memory of whatever runs next.
PIECES = 150_000

# Classes of bytes of UTF-8.  The tokenizer's pattern always ends a piece between another character and white
# space, between a letter or digit and a mark, and between white space other than a blank and another character,
# so the parts cut there are encoded alike alone and inside their text.
_BLANKS, _BREAK, _MARK, _SOLID, _LEAD = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[c for c in range(128) if chr(c).isalnum()]] = _SOLID
_CLASS[9:14], _CLASS[32] = _BREAK, _BLANKS
# First bytes of characters of two bytes from U+00C0 on; none is white space.
_CLASS[0xC3:0xE0] = _LEAD
# White space of several bytes.
_WIDE_GAPS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_GAPS = np.array([int.from_bytes(c, "big") for c in _WIDE_GAPS], np.uint32)
# A word of Latin letters, perhaps after one blank, is one piece of that pattern.
_WORD = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
# Bytes are spelled as characters: printable ones stand for themselves, the others follow from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLING = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_BLANK = _SPELLING[32]
#: New pieces that are encoded together.
TOGETHER = 1024
#: Rows that a task hands to its Python worker at once.
ROWS = 2000
#: Bytes of text that are cut into pieces together.
WINDOW = 4 << 20


def piece_cuts(data: np.ndarray, classes: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Whether a piece of UTF-8 bytes begins at a byte; the first one and one at a border of texts always do."""
    kind = classes[data]
    before, after = kind[:-1], kind[1:]
    gap, mark = after & (_BLANKS | _BREAK) != 0, after == _MARK
    cut = np.ones(len(data), bool)
    cut[1:] = (gap & (before & (_BLANKS | _BREAK) == 0)) | (mark & (before == _SOLID))
    # After a character of several bytes: not if it is white space, too; before a mark only if it is a Latin letter.
    wide = np.flatnonzero((data[:-1] >= 128) & (gap | mark)) + 1
    one, two, three = (np.where(wide >= n, data[wide - n], 0).astype(np.uint32) for n in (1, 2, 3))
    wide_gap = np.isin(two << 8 | one, _WIDE_GAPS) | np.isin(three << 16 | two << 8 | one, _WIDE_GAPS)
    code = (two & 31) << 6 | (one & 63)
    letter = (two >> 5 == 6) & (code >= 0xC0) & (code <= 0x24F) & (code != 0xD7) & (code != 0xF7)
    cut[wide] = np.where(kind[wide] == _MARK, letter, ~wide_gap)
    # The last break before a word is a piece of its own.
    alone = (before == _BREAK) & (after & (_MARK | _SOLID | _LEAD) != 0)
    borders = borders[(borders > 0) & (borders < len(data))]
    alone[borders - 1] = False
    cut[1:] |= alone
    cut[:-1] |= alone
    cut[borders] = True
    return cut


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes; remembers pieces of texts.

    Texts are cut into pieces as bytes, a window of ``WINDOW`` at a time; a piece is looked up once a window,
    and the ids of texts are put together by position.
    """

    def __init__(self, path: str, most: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Two generations: pieces in use move to the younger one, the elder is dropped whole.
        self.known: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        self.most = most
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark = special[0] if special else None
        # A tokenizer that only splits by the usual pattern and spells bytes as characters hands a word of
        # letters to its model as it is, so such words can go to the model at once.
        parts = json.loads(self.tokenizer.to_str())
        split = parts["pre_tokenizer"] or {}
        usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        added = any(_WORD.fullmatch(t["content"]) for t in parts["added_tokens"])
        self.model = self.tokenizer.model if usual and parts["normalizer"] is None and not added else None
        # Texts are cut only where that is known to change nothing: not at marks that an added token has.
        whole = [np.frombuffer(t["content"].encode(), np.uint8) for t in parts["added_tokens"]]
        self.classes = _CLASS.copy()
        for token in whole:
            self.classes[token[_CLASS[token] == _MARK]] = 0
        plain = parts["normalizer"] is None and not any(t["lstrip"] or t["rstrip"] for t in parts["added_tokens"])
        self.cuts = usual and plain and not any(piece_cuts(w, self.classes, np.empty(0, int))[1:].any() for w in whole)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of new pieces; a special token between them keeps them apart in one text."""
        whole = self.mark[1].join(pieces) if self.mark else ""
        if self.mark is None or whole.count(self.mark[1]) != len(pieces) - 1:
            return [ids.tobytes() for ids in self._ids(pieces)]
        ids = self._ids([whole])[0]
        cut = np.flatnonzero(ids == self.mark[0])
        starts, ends = np.concatenate(([0], cut + 1)) * 4, np.append(cut, len(ids)) * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of new words of letters by the tokenizer's model alone."""
        tokenize, ids, ends = self.model.tokenize, [], [0]
        for word in words:
            spelled = word.replace(" ", _BLANK) if word.isascii() else word.encode().decode("latin-1").translate(_SPELLING)
            ids += [t.id for t in tokenize(spelled)]
            ends.append(len(ids) * 4)
        raw = np.array(ids, "<u4").tobytes()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def _learn(self, new: list[str]) -> None:
        words, others = [], new
        if self.model is not None:
            others = []
            for piece in new:
                (words if _WORD.fullmatch(piece) else others).append(piece)
            self.known.update(zip(words, self._encode_words(words)))
        for at in range(0, len(others), TOGETHER):
            some = others[at : at + TOGETHER]
            self.known.update(zip(some, self._encode(some)))

    def look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, all different; new ones are remembered."""
        if len(self.known) > self.most:
            self.known, self.elder = {}, self.known
        found = list(map(self.known.get, pieces))
        absent = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in absent:
            ids = found[i] = self.elder.get(pieces[i])
            if ids is None:
                new.append(i)
            else:
                self.known[pieces[i]] = ids
        self._learn([pieces[i] for i in new])
        for i in new:
            found[i] = self.known[pieces[i]]
        return found

    def _window(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of ``data`` that begin at ``starts``, and how many ids come before each piece and the end."""
        ends = np.append(starts, len(data)).astype("<i8")
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        parts = self.look_up(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        widths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        which = pieces.indices.to_numpy()
        counts = widths[which]
        before = np.concatenate(([0], np.cumsum(counts)))
        # The n-th id of a piece stands n places after the first.
        at = np.repeat((np.cumsum(widths) - widths)[which] - before[:-1], counts)
        at += np.arange(before[-1])
        return np.frombuffer(b"".join(parts), "<u4")[at], before

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = column.cast(pa.large_string()).fill_null("")
        if not self.cuts:
            for text in column:
                yield self._ids([text.as_py()])[0].tobytes()
            return
        borders = np.frombuffer(column.buffers()[1] or bytes(8), "<i8")[column.offset :][: len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at, done, reach, parts = int(borders[0]), 1, WINDOW, []
        while done < len(borders):
            window = data[at : min(at + reach, borders[-1])]
            inside = borders[done : np.searchsorted(borders, at + len(window), "right")] - at
            starts = np.flatnonzero(piece_cuts(window, self.classes, inside))
            if len(window) not in inside[-1:]:
                # The last piece may go on.
                starts, window = starts[:-1], window[: starts[-1]]
                if not len(window):
                    reach *= 2
                    continue
            ids, before = self._window(window, starts)
            ended, last = before[np.searchsorted(starts, inside[inside <= len(window)])], 0
            for end in ended.tolist():
                yield b"".join([*parts, ids[last:end].tobytes()])
                parts, last = [], end
            parts.append(ids[last:].tobytes())
            at, done, reach = at + len(window), done + len(ended), WINDOW


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of a block of unsigned 32-bit ids, lowest first; all-zero planes are empty."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        rows = raw.T
    else:
        rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    return [squeeze.compress(np.ascontiguousarray(r).tobytes()) if r.any() else b"" for r in rows]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids of a block; the inverse of ``to_planes``."""
    width = n if kind == "byte" else (n + 7) // 8
    expand = zstandard.ZstdDecompressor()
    rows = np.zeros((len(planes), width), np.uint8)
    for row, plane in zip(rows, planes):
        if plane:
            row[:] = np.frombuffer(expand.decompress(plane, max_output_size=width), np.uint8)
    if kind == "bit":
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        rows = np.packbits(bits.T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes documents of ids, one after the other, to an open binary file."""

    def __init__(self, out, kind: str = "byte", block: int = BLOCK_IDS):
        self.out, self.kind, self.block = out, kind, block
        self.waiting, self.n_waiting, self.at = [], 0, 0
        self.chunks, self.doc_ids, self.lengths = [], [], []
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self, everything: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        end = len(ids) if everything else len(ids) // self.block * self.block
        for start in range(0, end, self.block):
            part = ids[start : min(start + self.block, end)]
            planes = to_planes(part, self.kind)
            self.chunks.append([self.at, len(part), [len(p) for p in planes]])
            self._write(b"".join(planes))
        self.waiting, self.n_waiting = [ids[end:].tobytes()], len(ids) - end

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= self.block:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        names = squeeze.compress(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        lengths = squeeze.compress(np.array(self.lengths, "<u8").tobytes())
        footer = {
            "kind": self.kind, "docs": len(self.lengths), "doc_ids": [self.at, len(names)],
            "lengths": [self.at + len(names), len(lengths)], "chunks": self.chunks,
            "no_id": [i for i, d in enumerate(self.doc_ids) if d is None],
        }
        index = json.dumps(footer).encode()
        self._write(names + lengths + index + len(index).to_bytes(8, "little") + MAGIC)


class PlaneReader:
    """Reads a file of planes block by block."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of id planes")
        n = int.from_bytes(tail[:8], "little")
        self.footer = json.loads(source.read_at(n, size - 16 - n))

    def ids(self, chunk: int) -> np.ndarray:
        """The ids of one block, found through the chunk index."""
        at, n, sizes = self.footer["chunks"][chunk]
        data, planes, start = self.source.read_at(sum(sizes), at), [], 0
        for size in sizes:
            planes.append(data[start : start + size])
            start += size
        return from_planes(planes, n, self.footer["kind"])

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids as bytes) in the order of the file; holds one document and one block."""
        expand, n = zstandard.ZstdDecompressor(), self.footer["docs"]

        def column(name: str, kind: str) -> np.ndarray:
            at, size = self.footer[name]
            return np.frombuffer(expand.decompress(self.source.read_at(size, at), max_output_size=8 * n), kind)

        if not n:
            return
        lost = set(self.footer["no_id"])
        blocks = (self.ids(k) for k in range(len(self.footer["chunks"])))
        have = np.empty(0, "<u4")
        for i, (doc_id, length) in enumerate(zip(column("doc_ids", "<i8").tolist(), column("lengths", "<u8").tolist())):
            parts, missing = [], length
            while missing:
                if not len(have):
                    have = next(blocks)
                parts.append(have[:missing].tobytes())
                missing -= min(missing, len(have))
                have = have[len(parts[-1]) // 4 :]
            yield (None if i in lost else doc_id), b"".join(parts)


def _open(path: str):
    system, place = fs.FileSystem.from_uri(path)
    return system, place


@dataclass(frozen=True)
class TokenFiles:
    """A written data set: the folder of its manifest."""

    spark: SparkSession
    manifest: str

    def files(self) -> DataFrame:
        """file, part, docs, ids, and ``first``: ids of all files before it (one row per file)."""
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        rows = self.spark.read.schema(_MANIFEST).parquet(self.manifest)
        return rows.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def documents(self) -> DataFrame:
        """(doc_id, start, ids): ids as little-endian unsigned 32-bit bytes, read from the files."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    system, place = _open(row["file"])
                    with system.open_input_file(place) as source:
                        yield from _batches(PlaneReader(source), row["first"])

        rows = self.files().select("file", "first")
        n = max(1, self.spark.read.schema(_MANIFEST).parquet(self.manifest).count())
        ship()
        # One file per task.
        return rows.repartitionByRange(n, "first", "file").mapInArrow(read, "doc_id long, start long, ids binary")


_MANIFEST = "file string, part int, docs long, ids long"


def _batches(reader: PlaneReader, first: int) -> Iterator[pa.RecordBatch]:
    names, starts, ids, size = [], [], [], 0
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
    for doc_id, data in reader.documents():
        names.append(doc_id)
        starts.append(first)
        ids.append(data)
        first += len(data) // 4
        size += len(data)
        if size >= READ_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((names, starts, ids), kinds.types)], schema=kinds)
            names, starts, ids, size = [], [], [], 0
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((names, starts, ids), kinds.types)], schema=kinds)


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, kind: str = "byte", block: int = BLOCK_IDS
) -> TokenFiles:
    """Tokenise all texts and write their ids in ascending doc_id order.

    ``tokenizer`` is the path of a tokenizers file that every machine has;
    ``folder`` a new folder that all machines share (by default one below
    ``spark.checkpoint.dir``).  NULL and empty texts are the end id alone.  Rows
    without doc_id come first; rows that share a doc_id are ordered by a hash of
    their text, and equal rows follow each other.  Other columns are not read.  An
    empty table gives no documents.
    """
    spark = ship()
    folder = folder or scratch_folder(spark, "tokens")
    files = f"{folder}/files"
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Ids that repeat, or are missing, are spread by the text.
    order = ["doc_id", "_tie"]
    placed = narrow.withColumn("_tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, tool, writer, n = np.array([end_id], "<u4").tobytes(), encoder(tokenizer), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                part = TaskContext.get().partitionId()
                name = f"{files}/part-{part:06d}-{uuid.uuid4().hex}.ids"
                system, place = _open(name)
                system.create_dir(os.path.dirname(place), recursive=True)
                out = system.open_output_stream(place)
                writer = PlaneWriter(out, kind, block)
            for key, ids in zip(batch.column(0).to_pylist(), tool.encode(batch.column(1))):
                writer.add(key, ids + end)
                n += len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"file": [name], "part": pa.array([part], pa.int32()), "docs": [len(writer.lengths)], "ids": [n]}
            )

    manifest = f"{folder}/manifest"
    with small_batches(spark, ROWS):
        placed.select("doc_id", "text").mapInArrow(write, _MANIFEST).write.parquet(manifest)
    return TokenFiles(spark, manifest)


def digest(documents: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents read back from files."""
    n = (F.octet_length("ids") / 4).cast("long")
    return documents.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
