"""Token ids in sorted-string-table shards, looked up by document identifier.

A shard holds one contiguous range of identifiers. Its layout, all integers little-endian:

* blocks: each a zstandard frame of entries; an entry is three varints (bytes shared with the
  previous key, further key bytes, value bytes), the key's rest and the value (token ids);
* index: for each block its last key, place, length, entries and the ids before it;
* Bloom filter: 10 bits a key, 7 probes by double hashing of XXH64;
* footer: 64 bytes with the places of index and filter, the counts, the width of an id and a magic.

A lookup asks the filter, finds the block by binary search in the index, and reads that block only.
"""

from __future__ import annotations

import io
import os
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptable.llm.common import shared_path, ship, text_of, worker_keeps

MAGIC = b"SNAPSST1"
FOOTER = struct.Struct("<QQQQQQQ8s")  # index at, index bytes, filter at, filter bytes, entries, ids, width, magic
BLOCK_BYTES = 1 << 16
PROBES, BITS_PER_KEY = 7, 10
CACHE_WORDS = 500_000


def key_of(value: int | str | None) -> bytes:
    """Bytes that sort as the identifiers do: null first, then numbers or code points."""
    if value is None:
        return b"\x00"
    return b"\x01" + (value.encode() if isinstance(value, str) else struct.pack(">Q", value + (1 << 63)))


def value_of(key: bytes, text: bool) -> int | str | None:
    if key == b"\x00":
        return None
    return key[1:].decode() if text else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = data[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + k * b) % bits for k in range(PROBES)]


class ShardWriter:
    """Streams entries in ascending key order; only the index and the keys' hashes stay in memory."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self.entries = self.ids = 0
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.hashes: list[bytes] = []
        self.pack = zstandard.ZstdCompressor(level=1)
        self._open()

    def _open(self) -> None:
        self.block, self.last, self.inside, self.before = bytearray(), b"", 0, self.ids

    def add(self, key: bytes, ids: bytes) -> None:
        shared = len(os.path.commonprefix([self.last, key])) if self.inside else 0
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last = key
        self.inside += 1
        self.entries += 1
        self.ids += len(ids) // self.width
        self.hashes.append(xxhash.xxh64_digest(key))
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.inside:
            data = self.pack.compress(bytes(self.block))
            self.out.write(data)
            self.index.append((self.last, self.at, len(data), self.inside, self.before))
            self.at += len(data)
        self._open()

    def close(self) -> None:
        self._flush()
        index = bytearray()
        for key, at, size, entries, before in self.index:
            index += _varint(len(key)) + key + _varint(at) + _varint(size) + _varint(entries) + _varint(before)
        bits = max(64, BITS_PER_KEY * self.entries)
        filled = np.zeros(bits, dtype=bool)
        if self.hashes:
            h = np.frombuffer(b"".join(self.hashes), dtype=">u8").astype(np.uint64)
            a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
            for k in range(PROBES):
                filled[(a + np.uint64(k) * b) % np.uint64(bits)] = True
        bloom = struct.pack("<Q", bits) + np.packbits(filled, bitorder="little").tobytes()
        self.out.write(bytes(index) + bloom)
        self.out.write(
            FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.ids, self.width, MAGIC)
        )


class ShardReader:
    """Reads a shard from a seekable binary file: all of it in order, or one key."""

    def __init__(self, file):
        self.file = file
        self.unpack = zstandard.ZstdDecompressor()
        end = file.seek(0, io.SEEK_END)
        if end < FOOTER.size:
            raise ValueError("not a shard: too short")
        index_at, index_size, bloom_at, bloom_size, self.entries, self.ids, self.width, magic = FOOTER.unpack(
            self._read(end - FOOTER.size, FOOTER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a shard: bad magic")
        data, at = self._read(index_at, index_size), 0
        self.index = []
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            place, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            entries, at = _read_varint(data, at)
            before, at = _read_varint(data, at)
            self.index.append((key, place, size, entries, before))
        bloom = self._read(bloom_at, bloom_size)
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, k: int) -> Iterator[tuple[bytes, int, bytes]]:
        _, place, size, entries, start = self.index[k]
        data, at, key = self.unpack.decompress(self._read(place, size)), 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + rest], at + rest
            value, at = data[at : at + length], at + length
            yield key, start, value
            start += length // self.width

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, ids of the shard before it, ids as bytes)"""
        for k in range(len(self.index)):
            yield from self._block(k)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every entry under a key; none if the key is absent."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        out, k = [], bisect_left([x[0] for x in self.index], key)
        while k < len(self.index):
            for found, _, value in self._block(k):
                if found == key:
                    out.append(np.frombuffer(value, dtype=f"<u{self.width}"))
                elif found > key:
                    return out
            k += 1
        return out


#: Words whose ids are surely those of the letters and then those of the marks: one pre-token each.
_PLAIN = re.compile(r"[a-z\u00e0-\u00f6\u00f8-\u00ff]+\Z")
_MARKS = b".,;:!?"
#: Texts that a tokenizer must give the same ids as a whole and by their words in lower case.
PROBE = ("Hello, World!  It's 3.50 (or 4)\tfor\nYOU; don't", "\u00c9t\u00e9  stra\u00dfe e\u0301 \u03a3\u0391\u03a3 x\u00a0y", " a  b ", "zq#%& --- http://x.org/Y?z=1", "\U0001f600 \u4e2d\u6587 \u0130 o.o")
_RUN = 256  # plain words encoded in one call


class WordEncoder:
    """Encodes texts word by word, with a bounded cache of words.

    With a lower-casing tokenizer whose pre-tokenizer drops white space and whose normalizer
    does not look across it, as the word-end BPE does, a text's ids are its words' ids in
    order. New plain words are encoded many at a time and told apart by their word-end ids. Texts that hold an
    added token in any case of letters, and all texts of a tokenizer that fails the probe, are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_words = [self.words([t])[0] for t in PROBE] == self._each([t.encode() for t in PROBE])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        if not self.by_words:
            return self._each([t.encode() for t in texts])
        raw = [t.encode() for t in texts]
        odd = {i for i, t in enumerate(raw) if any(a in t.lower() for a in self.added)}
        out = self.words([t for i, t in enumerate(texts) if i not in odd])
        for i in sorted(odd):
            out.insert(i, self._each([raw[i]])[0])
        return out

    def words(self, texts: list[str]) -> list[bytes]:
        words = [t.encode().lower().split() for t in texts]  # bytes: only A-Z change here
        if len(self.cache) > CACHE_WORDS:  # words not met again by the next time are forgotten
            self.older, self.cache = self.cache, {}
        missing = list(set().union(*words).difference(self.cache)) if words else []
        older = self.older
        self._learn([w for w in missing if w not in older])
        self.cache.update((w, older[w]) for w in missing if w in older)
        get = self.cache.__getitem__
        out = [b"".join(map(get, w)) for w in words]
        for w in missing:
            if len(w) > 64:  # long ones are not kept
                del self.cache[w]
        return out

    def _learn(self, missing: list[bytes]) -> None:
        cache, cores, composed, others = self.cache, set(), [], []
        for w in missing:
            core = w.rstrip(_MARKS)
            if core.isalpha() or (not core.isascii() and _PLAIN.match(core.decode())):  # bytes: only ASCII is alpha
                cores.add(core)
                if len(core) < len(w):
                    composed.append((w, core))
            else:
                others.append(w)
        known = self._plain(list(cores))
        marks = list({w[len(core) :] for w, core in composed})
        tails = dict(zip(marks, self._each(marks), strict=True))
        cache.update((c, known[c]) for c in cores.intersection(missing))
        cache.update((w, known[core] + tails[w[len(core) :]]) for w, core in composed)
        for at in range(0, len(others), 10_000):
            part = others[at : at + 10_000]
            cache.update(zip(part, self._each(part), strict=True))

    def _each(self, words: list[bytes]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in coded]

    def _plain(self, words: list[bytes]) -> dict[bytes, bytes]:
        found, size = {}, self.width
        runs = [words[at : at + _RUN] for at in range(0, len(words), _RUN)]
        for part, coded in zip(runs, self.tokenizer.encode_batch_fast([b" ".join(r).decode() for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, dtype=self.kind)
            ends = (np.flatnonzero(self.last[ids]) + 1) * size
            if len(ends) != len(part):  # a tokenizer without word ends
                found.update(zip(part, self._each(part), strict=True))
                continue
            raw, ends = ids.tobytes(), ends.tolist()
            found.update((w, raw[a:b]) for w, a, b in zip(part, [0, *ends], ends, strict=False))
        return found


def encoder(path: str) -> WordEncoder:
    return worker_keeps(f"encoder {path}", lambda: WordEncoder(path))


def _open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _pieces(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``most`` characters, with the place of their first."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t.as_py())
        size += len(held[-1])
        if size >= most:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def write_shards(
    docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1
) -> list[dict]:
    """Encodes every text, appends ``end_id``, and writes the shards; returns the manifest in key order.

    Rows are dealt by ranges of the identifier, so a shard is a range. A file's name holds its
    task attempt, and the manifest names the files of attempts that succeeded, so a lost or
    repeated task leaves at most an unnamed file. Null and empty texts hold the end id alone; null
    identifiers come first; repeated identifiers stay, ordered by text. No rows: an empty manifest."""
    spark = docs.sparkSession
    ship(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.sst"
        target = f"{folder.rstrip('/')}/{name}"
        out = writer = None
        code = encoder(tokenizer)
        end = int(end_id).to_bytes(code.width, "little")
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, texts in _pieces(batch.column(1)):
                for key, ids in zip(keys[at : at + len(texts)], code.encode(texts), strict=True):
                    if writer is None:
                        store, path = _open_fs(target)
                        store.create_dir(os.path.dirname(path), recursive=True)
                        out = store.open_output_stream(path)
                        writer, first = ShardWriter(out, code.width), key_of(key)
                    writer.add(key_of(key), ids + end)
        if writer:
            writer.close()
            out.close()
            row = {"shard": task.partitionId(), "path": target, "entries": writer.entries, "ids": writer.ids}
            row |= {"low": first.hex(), "high": writer.index[-1][0].hex()}
            yield pa.RecordBatch.from_pylist([row])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    if rows.schema["id"].dataType.typeName() != "string":
        rows = rows.withColumn("id", F.col("id").cast("bigint"))
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    made = ranged.mapInArrow(write, "shard bigint, path string, entries bigint, ids bigint, low string, high string").collect()
    manifest = sorted((r.asDict() for r in made), key=lambda r: r["shard"])
    start = 0
    for r in manifest:  # a row for each shard
        r["start"] = start
        start += r["ids"]
    return manifest


def read_shards(spark: SparkSession, manifest: list[dict], id_col: str = "doc_id", text_ids: bool = False) -> DataFrame:
    """One row per entry: identifier, ``start`` (ids of all entries before it), ``n_tokens``, ``ids_crc32``."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, path = _open_fs(r["path"])
                with store.open_input_file(path) as file:
                    shard = ShardReader(file)
                    for rows in _runs(shard, 2_000):
                        ids = [np.frombuffer(v, dtype=f"<u{shard.width}").astype("<u4") for _, _, v in rows]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([value_of(k, text_ids) for k, _, _ in rows], pa.string() if text_ids else pa.int64()),
                                pa.array([r["start"] + s for _, s, _ in rows], pa.int64()),
                                pa.array([len(x) for x in ids], pa.int64()),
                                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                            ],
                            names=["id", "start", "n_tokens", "ids_crc32"],
                        )

    kind = "string" if text_ids else "bigint"
    out = f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not manifest:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
    files = spark.createDataFrame([(r["path"], r["start"]) for r in manifest], "path string, start bigint")
    return files.repartition(len(manifest)).mapInArrow(read, out).withColumnRenamed("id", id_col)


def lookup(manifest: list[dict], key: int | str | None) -> list[np.ndarray]:
    """The ids of every document under an identifier: range, filter and index first, then one block."""
    coded, out = key_of(key), []
    at = bisect_left(manifest, coded, key=lambda r: bytes.fromhex(r["high"]))
    while at < len(manifest) and bytes.fromhex(manifest[at]["low"]) <= coded:
        store, path = _open_fs(manifest[at]["path"])
        with store.open_input_file(path) as file:
            out += ShardReader(file).get(coded)
        at += 1
    return out


def _runs(rows: Iterable, most: int) -> Iterator[list]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if len(held) >= most or size >= 8_000_000:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Writes the shards to a new folder below the shared one and reads them back: a row per row of ``docs``."""
    spark = docs.sparkSession
    folder = shared_path(spark, "shards")
    manifest = write_shards(docs, tokenizer, folder, id_col, text_col, end_id)
    return read_shards(spark, manifest, id_col, docs.schema[id_col].dataType.typeName() == "string")
