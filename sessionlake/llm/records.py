"""Operator 3: token ids as length-delimited binary records with masked checksums and a separate offset index.

A shard is a file of records, in ascending doc_id order within and across shards. A record is

    length of the payload   unsigned 64 bits, little-endian
    masked checksum of it   unsigned 32 bits
    payload                 doc_id (signed 64 bits), then the ids, 16 bits each where the vocabulary allows, else 32
    masked checksum of it   unsigned 32 bits

with checksum = CRC-32 and mask(c) = rotate right(c, 15) + 0xA282EAD8 modulo 2**32, so that a checksum stored inside
checksummed data does not fool it. The offset index is a Parquet table (shard, number, doc_id, offset, bytes, n_tokens):
a shuffled reader permutes its rows and reads each record by one ranged read.

A shard is written under its final name by one rename of a finished temporary file; a repeated task writes the same
bytes. Files go through pyarrow's file systems to the folder that the session shares, never to a local folder.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_pieces, scratch_path, stored, text_rows, trimmed

_MASK = 0xA282EAD8
_INDEX = "shard int, number long, doc_id long, offset long, bytes long, n_tokens long"
_ROW = [c.split()[0] for c in _INDEX.split(", ")]


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframed(source: BinaryIO) -> Iterator[bytes]:
    """The payloads of an open shard. Raises ValueError at a wrong checksum or a cut record."""
    while head := source.read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
            raise ValueError("a record's length is damaged")
        size = struct.unpack("<Q", head[:8])[0]
        body = source.read(size + 4)
        if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
            raise ValueError("a record's payload is damaged")
        yield body[:size]


#: Every character that some version of Unicode or some library takes for white space, or once did.
_BLANK = "\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as letters: printable ones as themselves, the rest as those from code 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Encodes whole texts by a file of the tokenizers library, with the ids of ``encode(add_special_tokens=False)``.

    A tokenizer of the byte-level kind cuts a text by a pattern before it merges bytes, and a space between two
    characters that nobody takes for white space always begins a piece: no part of the pattern goes on over such a
    space, and none looks behind. So the ids of a text are those of its stretches, cut there, one after the other. A
    stretch of ASCII (its printable characters and white space) and Latin letters alone is cut on into the pattern's
    pieces, since no version of Unicode differs on these characters; the library's model merges each piece once and the
    result is kept, up to ``most`` short pieces and stretches a process. The library gets all other stretches as they
    are, and texts that hold added tokens, or all texts where the tokenizer is of another kind, whole.

    ``encode_all`` gives the same ids for an array of texts: Arrow splits them, and a stretch that occurs in several places
    of the array is looked up once.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        state = json.loads(self.library.to_str())
        pre = state.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in state.get("added_tokens", [])]
        self.cuts = state["model"].get("type") == "BPE" and not state["model"].get("dropout") and not state.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.most = most
        self.known: dict[str, bytes] = {}
        # Fixed value: the pieces of byte-level BPE, over characters whose kind no version of Unicode changes.
        letters = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
        self.settled = re.compile(f"[\t-\r -~{letters}]+").fullmatch
        self.pieces = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[0-9]+| ?[!-/:-@\\[-`{{-~]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
        self.letters, self.model = _byte_letters(), self.library.model
        self.codes = [k.to_bytes(self.width, "little") for k in range(max(self.library.get_vocab(with_added_tokens=True).values(), default=0) + 1)]
        self.cut = re.compile(f" (?<=[^{_BLANK}] )(?=[^{_BLANK}])")
        blank = "".join(c if c == "-" else f"\\x{{{ord(c):x}}}" for c in _BLANK)
        self.blank = f"^[{blank}]|^$", f"[{blank}]$|^$"  # for Arrow's expressions

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, part: str, ids: bytes) -> bytes:
        if len(self.known) < self.most and len(part) <= 32:
            self.known[part] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.isprintable()  # only the space is then written otherwise
        raw = piece.replace(" ", self.letters[32]) if plain else piece.encode().decode("latin-1").translate(self.letters)
        codes = self.codes
        return self._keep(piece, b"".join([codes[t.id] for t in self.model.tokenize(raw)]))

    def _stretch(self, stretch: str) -> bytes:
        if not self.settled(stretch):
            return self._keep(stretch, self._batch([stretch])[0])
        pieces = self.pieces(stretch)
        if len(pieces) == 1:
            return self._piece(stretch)
        return self._keep(stretch, b"".join([self.known.get(p) or self._piece(p) for p in pieces]))

    def encode(self, text: str | None) -> bytes:
        """The ids, ``width`` bytes each."""
        if not text:
            return b""
        if not self.cuts or any(t in text for t in self.added):
            return self._batch([text])[0]
        known, stretch = self.known.get, self._stretch
        first, *rest = self.cut.split(text)
        return b"".join([known(p) or stretch(p) for p in [first, *[" " + x for x in rest]] if p])

    def encode_all(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The ids of all texts of an array of strings, one after the other, and where in these bytes each text's begin
        and the last one's end."""
        texts = pc.fill_null(texts, "")
        whole = pa.array(np.full(len(texts), not self.cuts))
        for t in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, t))
        parts = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        coded = parts.values.dictionary_encode()
        words, index, starts = coded.dictionary, coded.indices.to_numpy(), parts.offsets.to_numpy()
        # A stretch begins with a text or where its space is a cut; else it goes on over several parts.
        opens, closes = (pc.match_substring_regex(words, p).to_numpy(zero_copy_only=False) for p in self.blank)
        begins, head = np.ones(len(index), bool), np.zeros(len(index), bool)
        begins[1:] = ~(closes[index[:-1]] | opens[index[1:]])
        begins[starts[:-1]] = head[starts[:-1]] = True
        at = np.flatnonzero(begins)
        head, size = head[at], np.diff(at, append=len(index))
        odd = head | (size > 1)
        used = np.zeros(len(words), bool)
        used[index[at[~odd]]] = True
        words = words.to_numpy(zero_copy_only=False)
        known, stretch = self.known.get, self._stretch
        ids = [known(p) or stretch(p) for p in [" " + x for x in words[used].tolist()]]
        code, others = (np.cumsum(used) - 1)[index[at]], {"": len(ids)}
        ids.append(b"")
        for k, start, n, first in zip(np.flatnonzero(odd).tolist(), at[odd].tolist(), size[odd].tolist(), head[odd].tolist()):
            p = ("" if first else " ") + " ".join(words[index[start : start + n]].tolist())
            if p not in others:
                others[p] = len(ids)
                ids.append(known(p) or stretch(p))
            code[k] = others[p]
        starts = np.searchsorted(at, starts)
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            code[starts[k]] = len(ids)
            ids.append(self._batch([texts[k].as_py()])[0])
        found = pa.array(ids, pa.large_binary()).take(pa.array(code))
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(found).to_numpy())))
        return memoryview(found.buffers()[2] or b""), ends[starts]


_ENCODERS: dict[tuple[str, int], Encoder] = {}
_PIECES = 400_000


def encoder(path: str, most: int = _PIECES) -> Encoder:
    """One for each file and process, kept while the process lives."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = Encoder(path, most)
    return _ENCODERS[path, most]


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, most: int = _PIECES) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards below ``folder`` and return the offset index, itself stored there.

    Documents are dealt by ranges of doc_id, so shards follow each other and a hot source is nothing special. Null
    texts are empty documents: ``end_id`` alone. Rows that repeat a doc_id follow one another, by text; a null doc_id
    sorts first and is written as the least 64-bit number. An empty table gives no shard and an empty index.
    """
    rows = text_rows(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        own = encoder(tokenizer, most)
        end = np.array([end_id], dtype=own.kind).tobytes()
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        final, part = f"{root}/shard-{shard:06d}.rec", f"{root}/.{uuid.uuid4().hex}"
        offset, number, out = 0, 0, None
        try:
            for batch in arrow_pieces(batches):
                data, at = own.encode_all(batch["text"])
                records = []
                for k, doc in enumerate(batch["doc_id"].to_pylist()):
                    records.append(framed(b"".join((struct.pack("<q", -(1 << 63) if doc is None else doc), data[at[k] : at[k + 1]], end))))
                out = out or files.open_output_stream(part)
                out.write(b"".join(records))
                sizes = np.array([len(r) for r in records], dtype="int64")
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(sizes), shard, dtype="int32")),
                    pa.array(np.arange(number, number + len(sizes))),
                    batch["doc_id"],
                    pa.array(offset + np.cumsum(sizes) - sizes),
                    pa.array(sizes),
                    pa.array(np.diff(at) // own.width + 1),
                ], names=_ROW)
                offset, number = offset + int(sizes.sum()), number + len(sizes)
            if out:
                out.close()
                files.move(part, final)
                out = None
        finally:
            if out:
                out.close()
                files.delete_file(part)

    path = f"{folder}/index"
    rows.mapInArrow(trimmed(run), _INDEX).write.parquet(path)
    (spark := docs.sparkSession).createDataFrame([(encoder(tokenizer).width,)], "id_bytes int").coalesce(1).write.parquet(f"{folder}/format")
    return spark.read.schema(_INDEX).parquet(path)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, shard, number, n_tokens, start (ids of all records before it), ids_crc32: every record, read back and
    checked. A task reads one shard, a record at a time."""
    width = spark.read.parquet(f"{folder}/format").first()["id_bytes"]
    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    shards, _ = stored(index.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.max("offset").alias("last")), "record-shards")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        kind = np.dtype("<u2" if width == 2 else "<u4")
        for frame in frames:
            for shard in frame["shard"].tolist():
                out, start = [], 0
                with store.open_input_stream(f"{root}/shard-{shard:06d}.rec", buffer_size=1 << 20) as source:
                    for number, payload in enumerate(unframed(source)):
                        ids = np.frombuffer(payload, dtype=kind, offset=8)
                        doc = struct.unpack_from("<q", payload)[0]
                        out.append((None if doc == -(1 << 63) else doc, shard, number, len(ids), start, zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) >= 10_000:
                            yield pd.DataFrame(out, columns=_READ).astype({"doc_id": "Int64"})
                            out = []
                if out:
                    yield pd.DataFrame(out, columns=_READ).astype({"doc_id": "Int64"})

    # A row for each file: few and small, so one task may sum them up.
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = shards.withColumn("base", F.coalesce(before, F.lit(0))).select("shard", "base")
    files = shards.count()
    dealt = shards.select("shard").repartition(max(1, files), "shard")
    read = dealt.mapInPandas(trimmed(run), "doc_id long, shard int, number long, n_tokens long, start long, ids_crc32 long")
    # Of the two sides, only the one with a row a file may ever be broadcast.
    bases = F.broadcast(bases) if files <= 200_000 else bases.hint("merge")
    return read.join(bases, "shard").withColumn("start", F.col("start") + F.col("base")).drop("base")


_READ = ["doc_id", "shard", "number", "n_tokens", "start", "ids_crc32"]


def record_at(folder: str, shard: int, offset: int, size: int, width: int) -> tuple[int, np.ndarray]:
    """One record by its row of the offset index: doc_id and ids, by one ranged read."""
    import io

    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{root}/shard-{shard:06d}.rec") as source:
        source.seek(offset)
        payload = next(unframed(io.BytesIO(source.read(size))))
    return struct.unpack_from("<q", payload)[0], np.frombuffer(payload, dtype="<u2" if width == 2 else "<u4", offset=8)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, most: int = _PIECES) -> DataFrame:
    """Write ``docs`` to ``folder`` (a scratch folder unless given) and read the records back. ``most``: short pieces of
    text whose ids a process remembers, some 200 bytes each."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "records")
    write_shards(docs, tokenizer, folder, end_id, most)
    return read_shards(spark, folder)
