"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their key. File layout, all numbers little-endian:

    blocks   zstd frames; inside, entries of (shared, rest, ids: varints; rest of the key; ids, 2 or 4 bytes each): a key
             gives only what differs from the key before it in its block
    index    per block: length of its first key (2 bytes), that key, offset (8), bytes (4)
    bloom    bits of a Bloom filter over the keys
    footer   64 bytes: offsets of index and bloom (8 each), blocks (4), bloom bits (8), bytes of an id (4), entries (8),
             ids (8), zeros, the mark FWSST001

A key is one byte 1 and the id in 8 bytes, big-endian with the sign bit turned, so that bytes sort as ids do; a null id is the
single byte 0 and sorts first. A lookup reads footer, Bloom filter and index, bisects the index and reads one block.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, new_dir

MARK = b"FWSST001"
BLOCK_BYTES = 64 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Words that a worker remembers at most, and how long they may be: some 100 MB at worst. Longer ones are encoded each time.
CACHED_WORDS, CACHED_LENGTH = 300_000, 64
SEPARATORS, NOT_SPACE = re.compile("[\x1c-\x1f]"), re.compile(r"(?:\S|[\x1c-\x1f])+")
_FOOTER = struct.Struct("<QQIQIQQ8x8s")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bloom_hashes(key: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1


def _bloom_bits(key: bytes, bits: int) -> list[int]:
    a, b = _bloom_hashes(key)
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class TableWriter:
    """Writes entries, given in key order, to a file object."""

    def __init__(self, out, id_bytes: int = 2):
        self.out, self.id_bytes, self.zstd = out, id_bytes, zstandard.ZstdCompressor(level=1)
        self.block, self.first, self.before = bytearray(), b"", b""
        self.index, self.hashes, self.entries, self.at, self.ids = [], array("Q"), 0, 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.block:
            self.first = key
        shared = 0
        if self.block:
            most = min(len(key), len(self.before))
            while shared < most and key[shared] == self.before[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:]
        self.block += ids.astype(f"<u{self.id_bytes}").tobytes()
        self.before = key
        self.hashes.extend(_bloom_hashes(key))  # 16 bytes an entry: the keys themselves stay in the file
        self.entries += 1
        self.ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            packed = self.zstd.compress(bytes(self.block))
            self.out.write(packed)
            self.index.append((self.first, self.at, len(packed)))
            self.at += len(packed)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        bits = max(64, self.entries * BLOOM_BITS)
        bloom = np.zeros(bits, bool)
        a, b = np.frombuffer(self.hashes, np.uint64).reshape(-1, 2).T % np.uint64(bits)
        for i in range(BLOOM_HASHES):
            bloom[(a + np.uint64(i) * b) % np.uint64(bits)] = True
        self.out.write(index + np.packbits(bloom, bitorder="little").tobytes())
        self.out.write(_FOOTER.pack(self.at, self.at + len(index), len(self.index), bits, self.id_bytes, self.entries, self.ids, MARK))


class TableReader:
    """Reads a file of TableWriter: all entries in order, or one key's by its block."""

    def __init__(self, file):
        self.file, size = file, file.size()
        foot = self._read(size - _FOOTER.size, _FOOTER.size)
        self.index_at, self.bloom_at, n, self.bits, self.id_bytes, self.entries, self.n_ids, mark = _FOOTER.unpack(foot)
        if mark != MARK:
            raise ValueError("not a sorted string table")
        raw, at, self.index = self._read(self.index_at, self.bloom_at - self.index_at), 0, []
        for _ in range(n):
            k = struct.unpack_from("<H", raw, at)[0]
            self.index.append((raw[at + 2:at + 2 + k], *struct.unpack_from("<QI", raw, at + 2 + k)))
            at += 14 + k
        self.bloom = self._read(self.bloom_at, (self.bits + 7) // 8)
        self.zstd = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, block: tuple) -> Iterator[tuple[bytes, np.ndarray]]:
        raw, at, key = self.zstd.decompress(self._read(block[1], block[2])), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at:at + rest]
            at += rest
            yield key, np.frombuffer(raw, f"<u{self.id_bytes}", n, at)
            at += n * self.id_bytes

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in self.index:
            yield from self._entries(block)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every entry with that key, in order; none if there is none."""
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(key, self.bits)):
            return []
        firsts = [b[0] for b in self.index]
        at, out = max(0, bisect_right(firsts, key) - 1), []
        while at and firsts[at] == key:  # repeated keys may have begun a block before
            at -= 1
        for block in self.index[at:]:
            if block[0] > key:
                break
            out += [ids for k, ids in self._entries(block) if k == key]
        return out


class WordEncoder:
    """The tokenizer's ids of whole texts. Three exact shortcuts, each used only if samples show that the tokenizer allows it:

    - white space parts its pre-tokens and is dropped, so a text's ids are those of its words, each encoded once while remembered;
    - a word of Latin letters with marks after it is two pre-tokens;
    - the letters are one pre-token that only is lower-cased and spelt in bytes, so the model can be asked without the
      normaliser and the pre-tokenizer's patterns, which take most of the time.
    """

    LETTERS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?*#$%&|]*)")
    SAMPLES = ("the", "Thstinn", "\u00c9l\u00e8ve", "gr\u00fc\u00dfe", "\u00ff\u00f1o", "a", "WORLD")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.bytewise = {c: "".join(_BYTE_SIGNS[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        full = self.full
        self.by_word = all(full(f"{x}{gap}{y}") == full(x) + full(y) for x in self.SAMPLES for y in self.SAMPLES for gap in (" ", "\n", " \t"))
        self.simple = self.by_word and all(self.letters(w) == full(w) and full(w + ".,") == full(w) + full(".,") for w in self.SAMPLES)

    def full(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, word: str) -> bytes:
        low = word.lower()
        return array("I", [t.id for t in self.model.tokenize(low if low.isascii() else low.translate(self.bytewise))]).tobytes()

    def word(self, word: str) -> bytes:
        if not self.simple:
            return self.full(word)
        if word.isascii() and word.isalpha():
            return self.part(word.lower(), self.letters)
        found = self.LETTERS.fullmatch(word)
        if not found:
            return self.full(word)
        head = self.part(found[1].lower(), self.letters)
        return head + self.part(found[2], self.full) if found[2] else head

    def part(self, part: str, encode: Callable[[str], bytes]) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = encode(part)
            if len(part) <= CACHED_LENGTH:
                if len(self.parts) >= CACHED_WORDS:
                    self.parts.clear()
                self.parts[part] = ids
        return ids

    def __call__(self, text: str) -> np.ndarray:
        if not self.by_word:
            return np.frombuffer(self.full(text), "<u4")
        # Python's split() also cuts at U+001C to U+001F, which the tokenizer keeps
        words = text.split() if not SEPARATORS.search(text) else NOT_SPACE.findall(text)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known = self.known
        out = list(map(known.get, words))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    w = words[i]
                    out[i] = known.get(w) or (self.word(w) if len(w) > CACHED_LENGTH else known.setdefault(w, self.word(w)))
        return np.frombuffer(b"".join(out), "<u4")


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One a worker process, kept over its tasks."""
    return WordEncoder(path)


def _byte_signs() -> dict[int, str]:
    """Byte-level spelling: printable bytes stand for themselves, the others for U+0100 and on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


_BYTE_SIGNS = _byte_signs()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def write_tables(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, rows_per_shard: int = 1_000_000) -> DataFrame:
    """Writes the shards under path, a folder that all executors share, and returns the manifest, one row per file: file, shard,
    entries, n_ids, first_id, last_id, and start, the number of ids in the shards before it.

    Documents are in ascending order of their id over all shards (null first; of repeated ids, by the text); end_id follows each
    text. A null or empty text has that id only; texts of any length are written whole. An empty table gives no file. A task writes to a name of its own and renames it, so a task that runs
    again replaces the file by the same one. Repeated rows have an entry each. Without shards, the session's number of shuffle partitions, or
    as many as rows_per_shard rows each ask for: what a task holds of a shard is its index and some 30 bytes an entry."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    spark = docs.sparkSession
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_shard))
    rows = rows.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "t")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(path)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        shard = context.partitionId()
        own = f"{root}/.{shard}-{context.taskAttemptId()}"
        encode, end, table, first, last = encoder(tokenizer), np.array([end_id], "<u4"), None, None, None
        with fs.open_output_stream(own) as out:
            table = TableWriter(out, 2 if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 65536 else 4)
            for pdf in batches:
                for i, t in zip(pdf["id"].astype("Int64"), pdf["t"], strict=True):
                    i = None if pd.isna(i) else int(i)
                    table.add(key_of(i), np.concatenate([encode(t if isinstance(t, str) else ""), end]))
                    first, last = (i if table.entries == 1 else first), i
            table.close()
        if not table.entries:
            fs.delete_file(own)
            return
        name = f"{root}/part-{shard:06d}.sst"
        fs.move(own, name)
        yield pd.DataFrame({"file": [f"part-{shard:06d}.sst"], "shard": [shard], "entries": [table.entries], "n_ids": [table.ids], "first_id": pd.array([first], "Int64"), "last_id": pd.array([last], "Int64")})

    made = cut(rows.mapInPandas(write, "file string, shard int, entries bigint, n_ids bigint, first_id bigint, last_id bigint"))
    # one row a file: small, however large the input
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tables(manifest: DataFrame, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of every document."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(path)
        for pdf in batches:
            for file, start in zip(pdf["file"], pdf["start"], strict=True):
                out: list[tuple] = []
                with fs.open_input_file(f"{root}/{file}") as f:
                    for key, ids in TableReader(f):
                        out.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})
                            out = []
                yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    files = manifest.select("file", "start")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "file").mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def look_up(manifest: DataFrame, path: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of a document, one array for each of its rows, none if it is not there or the table is empty: its files by the manifest, then a
    binary search in each. A null id is looked up like any other."""
    at = F.col("first_id").eqNullSafe(doc_id) if doc_id is None else (F.coalesce(F.col("first_id") <= doc_id, F.lit(True)) & (F.col("last_id") >= doc_id))
    fs, root = open_fs(path)
    out = []
    for r in manifest.where(at).orderBy("shard").select("file").collect():
        with fs.open_input_file(f"{root}/{r.file}") as f:
            out += TableReader(f).get(key_of(doc_id))
    return out


def encoded_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Encodes documents, writes the shards to a new folder in the shared one and returns what is read back from them: one row per row of
    docs, repeated ones and those without id too. An empty table gives an empty result. Other columns are not used."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = new_dir(docs.sparkSession, "sst")
    return read_tables(write_tables(docs, path, tokenizer, end_id), path)
