"""Token-ID storage: byte- or bit-plane shuffled blocks, compressed plane by plane.

File layout (little-endian)::

    b"TPL1" | chunk ... | footer (zstd JSON) | footer length u32 | b"TPL1"

A chunk holds up to ``block_ids`` ids as planes of equal length.  Plane ``p`` of
a byte block has byte ``p`` of every id, plane ``p`` of a bit block has bit
``p``; planes that are zero throughout are left out.  The footer is the chunk
index: offset, ids, and (plane, compressed size) of each chunk, and the ids and
lengths of the documents, which may span chunks.  One file holds one range of
``doc_id``; ``manifest.json`` lists the files in order with the number of ids
before each, and is renamed into place last.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from base64 import b64decode, b64encode
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common

MAGIC = b"TPL1"
BLOCK_IDS = 1 << 18
CACHE_WORDS, JOINED, PARTS = 600_000, 400, 40
#: Ids after which a shard goes on in another file.
ROLL_IDS = 1 << 26
ROWS = 20_000
WRITTEN = "shard long, file string, docs long, ids long"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, bits: bool) -> Iterator[tuple[int, bytes]]:
    """The planes of a block that are not all zero."""
    if bits:
        used = int(np.bitwise_or.reduce(ids)) if len(ids) else 0
        for p in range(32):
            if used >> p & 1:
                yield p, np.packbits((ids >> np.uint32(p)).astype(np.uint8) & 1).tobytes()
    else:
        by_byte = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
        for p in range(4):
            plane = by_byte[:, p]
            if plane.any():
                yield p, plane.tobytes()


def from_planes(n: int, planes: list[tuple[int, bytes]], bits: bool) -> np.ndarray:
    if bits:
        ids = np.zeros(n, np.uint32)
        for p, data in planes:
            ids |= np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(np.uint32) << np.uint32(p)
        return ids
    by_byte = np.zeros((n, 4), np.uint8)
    for p, data in planes:
        by_byte[:, p] = np.frombuffer(data, np.uint8)
    return by_byte.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; ``add`` takes a document's ids as little-endian bytes."""

    def __init__(self, stream, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = 1):
        self.stream, self.block_ids, self.bits = stream, block_ids, bits
        self.packer = zstandard.ZstdCompressor(level=level)
        self.waiting, self.n_waiting, self.offset = [], 0, len(MAGIC)
        self.chunks, self.doc_ids, self.lengths, self.total = [], [], [], 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.doc_ids.append(doc_id)
        self.lengths.append(n)
        self.total += n
        self.waiting.append(ids)
        self.n_waiting += n
        if self.n_waiting >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        whole = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for at in range(0, whole, self.block_ids):
            block, planes = ids[at : at + self.block_ids], []
            begin = self.offset
            for p, plane in to_planes(block, self.bits):
                data = self.packer.compress(plane)
                self.stream.write(data)
                planes.append([p, len(data)])
                self.offset += len(data)
            self.chunks.append([begin, min(self.block_ids, whole - at), planes])
        self.waiting, self.n_waiting = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> None:
        if self.n_waiting:
            self._flush(True)
        known = np.array([x is not None for x in self.doc_ids], np.uint8)
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        pack = lambda x: b64encode(self.packer.compress(x.tobytes())).decode()
        footer = self.packer.compress(json.dumps({"bits": self.bits, "chunks": self.chunks, "docs": len(ids), "doc_ids": pack(ids), "known": pack(known), "lengths": pack(np.array(self.lengths, "<i8"))}).encode())
        self.stream.write(footer + struct.pack("<I", len(footer)) + MAGIC)


class PlaneReader:
    """Reads one file of a random-access source, chunk by chunk."""

    def __init__(self, source):
        self.source, size = source, source.size()
        self.unpacker = zstandard.ZstdDecompressor()
        source.seek(size - 8)
        length, magic = struct.unpack("<I4s", source.read(8))
        if magic != MAGIC:
            raise ValueError("not a token plane file, or one that was cut short")
        source.seek(size - 8 - length)
        index = json.loads(self.unpacker.decompress(source.read(length)))
        self.bits, self.chunks = index["bits"], index["chunks"]
        get = lambda k, kind: np.frombuffer(self.unpacker.decompress(b64decode(index[k])) if index["docs"] else b"", kind)
        self.doc_ids, self.known, self.lengths = get("doc_ids", "<i8"), get("known", np.uint8), get("lengths", "<i8")

    def blocks(self) -> Iterator[np.ndarray]:
        for offset, n, planes in self.chunks:
            self.source.seek(offset)
            data = [(p, self.unpacker.decompress(self.source.read(size))) for p, size in planes]
            yield from_planes(n, data, self.bits)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        blocks, rest = self.blocks(), np.zeros(0, "<u4")
        for doc_id, known, n in zip(self.doc_ids.tolist(), self.known.tolist(), self.lengths.tolist(), strict=True):
            parts = []
            while n > len(rest):
                parts.append(rest)
                n -= len(rest)
                rest = next(blocks)
            parts.append(rest[:n])
            rest = rest[n:]
            yield doc_id if known else None, np.concatenate(parts) if len(parts) > 1 else parts[0]


#: The text rules under which a text's ids are those of its white-space separated pieces.
NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
SPLITTERS = (
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
)


class WholeEncoder:
    """Ids of whole texts, for any tokenizer file."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, texts: list[bytes], at_once: int = 1 << 20) -> Iterator[bytes]:
        """The ids of each text as little-endian bytes; texts of about ``at_once`` bytes are encoded together."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and size < at_once:
                size += len(texts[end])
                end += 1
            for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts[begin:end]], add_special_tokens=False):
                yield np.array(x.ids, "<u4").tobytes()
            begin = end


class Pieces(dict):
    """Ids of words; a word that is looked up for the first time is noted in ``new`` and has its number there for now."""

    def __init__(self):
        self.new = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.new)
        self.new.append(word)
        return n


class WordEncoder:
    """Ids of whole texts, through a bounded cache of white-space separated pieces.

    For tokenizers of the rules above only: these drop white space, and none of
    their patterns, nor NFC, crosses ASCII white space.  A piece of Latin letters
    and then punctuation is encoded as these two, the letters once for all
    their cases; other pieces are encoded as they are.
    """

    #: Precomposed Latin letters of which each has one lower-case letter, then ASCII marks.
    PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\\[-`{-~]*)")

    def __init__(self, tokenizer, suffix: str):
        self.tokenizer, self.cache, self.parts = tokenizer, Pieces(), {}
        names = tokenizer.get_vocab()
        self.last = np.zeros(max(names.values(), default=0) + 1, bool)
        self.last[[i for name, i in names.items() if name.endswith(suffix)]] = True

    def _alone(self, pieces: list[str]) -> Iterator[bytes]:
        for i in range(0, len(pieces), JOINED):
            for x in self.tokenizer.encode_batch_fast(pieces[i : i + JOINED], add_special_tokens=False):
                yield np.array(x.ids, "<u4").tobytes()

    def _joined(self, words: list[str]) -> Iterator[bytes]:
        """Words of letters alone: each is one piece, so its last id, and none before, ends a word."""
        for i in range(0, len(words), JOINED * PARTS):
            own = [words[k : k + JOINED] for k in range(i, min(i + JOINED * PARTS, len(words)), JOINED)]
            for part, x in zip(own, self.tokenizer.encode_batch_fast([" ".join(p) for p in own], add_special_tokens=False), strict=True):
                ids = np.array(x.ids, "<u4")
                ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
                if len(ends) != len(part):
                    yield from self._alone(part)
                    continue
                data = ids.tobytes()
                yield from map(data.__getitem__, map(slice, [0, *ends[:-1]], ends))

    def _learn(self, words: list[bytes]) -> None:
        plain, letters, marks, other = [], [], [], []
        for word in words:
            if word.isalpha():  # ASCII letters alone, as bytes
                plain.append(word)
                letters.append(word.lower().decode())
                marks.append("")
            elif found := self.PLAIN.fullmatch(word.decode()):
                plain.append(word)
                letters.append(found[1].lower())
                marks.append(found[2])
            else:
                other.append(word)
        if len(self.parts) + len(plain) > CACHE_WORDS:
            self.parts.clear()
        parts = self.parts
        new = list(set(letters) - parts.keys())
        parts.update(zip(new, self._joined(new), strict=True))
        new = list(set(marks) - parts.keys())
        parts.update(zip(new, self._alone(new), strict=True))
        get = parts.__getitem__
        self.cache.update(zip(plain, map(add, map(get, letters), map(get, marks)), strict=True))
        self.cache.update(zip(other, self._alone([w.decode() for w in other]), strict=True))

    def encode(self, texts: list[bytes], at_once: int = 2 << 20) -> Iterator[bytes]:
        """The ids of each text as little-endian bytes; words are looked up for about ``at_once`` bytes of text together."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and size < at_once:
                size += len(texts[end])
                end += 1
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            # One look-up a word: the cache is larger than the processor's.
            cache, get = self.cache, self.cache.__getitem__
            try:
                found = [list(map(get, t.split())) for t in texts[begin:end]]
                if cache.new:
                    self._learn(cache.new)
            except BaseException:  # no number may stay for a word's ids
                cache.clear()
                cache.new = []
                raise
            late, cache.new = list(map(get, cache.new)), []
            for own in found:
                if late:
                    own = [x if x.__class__ is bytes else late[x] for x in own]
                yield b"".join(own)
            begin = end


def encoder_of(path: str) -> WordEncoder | WholeEncoder:
    """One for each Python worker, which keeps it from task to task; by words only where the file's rules are the known ones."""
    known = common.KEPT.setdefault("encoder", {})
    if path not in known:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            rules = json.load(source)
        steps = lambda key, inner: tuple((rules.get(key) or {}).get(inner, ()))
        special = rules.get("added_tokens") or []
        by_words = (
            steps("normalizer", "normalizers") == NORMALIZERS
            and steps("pre_tokenizer", "pretokenizers") == SPLITTERS
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["content"] or t["content"].split() != [t["content"]] for t in special)
            and rules["model"]["type"] == "BPE"
            and rules["model"].get("dropout") is None
            and rules["model"].get("end_of_word_suffix")
        )
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known[path] = WordEncoder(tokenizer, rules["model"]["end_of_word_suffix"]) if by_words else WholeEncoder(tokenizer)
    return known[path]


def write_planes(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, bits: bool = False, block_ids: int = BLOCK_IDS, roll_ids: int = ROLL_IDS) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes them in ascending doc_id order.

    A null text counts as empty and holds only ``end_id``; a null doc_id sorts
    first; repeated rows are all kept, equal ids ordered by text; an empty table
    gives no shard.  A text of any length is one document; a file ends after the
    document with which it reaches ``roll_ids``.  Other columns are not read.
    Returns the manifest: one row for each file with ``start``, the ids in the
    files before it.
    """
    spark = docs.sparkSession
    end = struct.pack("<I", end_id)

    def write(batches):
        shard, attempt, roll = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        common.release("encoder")
        files, path = common.filesystem(folder)
        encoder, writer, stream = encoder_of(tokenizer_path), None, None

        def finish():
            writer.close()
            stream.close()
            name = f"shard-{shard:06d}-{roll:04d}.tpl"
            files.move(temporary, f"{path}/{name}")
            return pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "docs": [len(writer.lengths)], "ids": [writer.total]})

        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            texts = batch.column("text").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                if writer is None:
                    files.create_dir(path, recursive=True)
                    temporary = f"{path}/.shard-{shard:06d}-{roll:04d}.{attempt}.tmp"
                    stream = files.open_output_stream(temporary, compression=None)
                    writer = PlaneWriter(stream, block_ids, bits)
                writer.add(doc_id, ids + end)
                if writer.total >= roll_ids:
                    yield finish()
                    writer, roll = None, roll + 1
        if writer:
            yield finish()
        common.release("encoder")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    shards = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(write, WRITTEN)
    listed, start = [], 0
    for row in sorted(shards.collect()):  # one small row for each file
        listed.append([*row, start])
        start += row.ids
    common.publish(folder, "manifest.json", json.dumps({"format": MAGIC.decode(), "columns": ["shard", "file", "docs", "ids", "start"], "shards": listed}).encode())
    return spark.createDataFrame(listed, f"{WRITTEN}, start long")


def read_planes(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each stored document, computed from the files of the manifest; none where it lists no file.

    Null and repeated ids come back as they were stored, ``start`` telling them apart.
    """
    files, path = common.filesystem(folder)
    with files.open_input_file(f"{path}/manifest.json") as source:
        shards = json.loads(source.read())["shards"]

    def read(batches):
        names = [x.split()[0] for x in DOCUMENT.split(", ")]
        said = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)
        for batch in batches:
            for i in batch.column("id").to_pylist():
                own, at = common.filesystem(folder)
                _, name, _, _, start = shards[i]
                rows = []
                with own.open_input_file(f"{at}/{name}") as source:
                    for doc_id, ids in PlaneReader(source).documents():
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == ROWS:
                            yield said(rows)
                            rows = []
                if rows:
                    yield said(rows)

    if not shards:
        return spark.createDataFrame([], DOCUMENT)
    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(read, DOCUMENT)
