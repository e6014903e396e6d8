"""Operator 6: token ids in Arrow files of equal-length sequences.

Documents are range-partitioned by id; each task encodes its own in order and
writes one shard: an Arrow IPC file whose batches hold two fixed-size-list
columns, ``ids`` and ``mask``.  A memory map of a shard gives any sequence
without a copy.  A second small file lists the shard's documents and their
lengths.  Shards are written under a temporary name and renamed, so a task
that runs again leaves one whole file; the folder is the shared one.

Encoding goes through the tokenizers library, one pre-token at a time: texts
are cut where the tokenizer's pattern cuts them and each distinct piece is
encoded once for a worker.  Pieces are known by their bytes, never by a hash
alone.  Texts with other characters than ASCII and the letters of Latin-1, and
all texts where the file's rules are other than those that ``cut`` follows,
are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import fresh_path, stored
from .textkernels import WordHasher, mixed, pieces, trim, utf8

LENGTH, END_ID = 2048, 2
#: Sequences in a record batch.
BATCH = 64
#: Distinct pieces a worker remembers (about 80 bytes each), and bytes of those longer than two lanes.
REMEMBERED, REMEMBERED_BYTES = 500_000, 1 << 24
#: Bytes of text in a shard, about.
SHARD_BYTES = 1 << 27


class PieceTable:
    """An open-addressing hash table from 64-bit hashes to 0, 1, 2, ... in order of arrival."""

    def __init__(self, slots: int = 1 << 16):
        self.keys, self.values, self.count = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash (not 0), or -1."""
        m = np.uint64(len(self.keys) - 1)
        slot = h & m
        k = self.keys[slot]
        out = np.where(k == h, self.values[slot], -1)
        left = np.flatnonzero((k != h) & (k != 0))
        slot = (slot[left] + np.uint64(1)) & m
        while len(left):
            k = self.keys[slot]
            hit = k == h[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (k != 0)
            left, slot = left[go], (slot[go] + np.uint64(1)) & m
        return out

    def add(self, h: np.ndarray, numbers: np.ndarray | None = None) -> None:
        """Number distinct hashes that the table lacks, from ``count`` on unless told."""
        if numbers is None:
            numbers = np.arange(self.count, self.count + len(h))
        self.count += len(h)
        if 2 * self.count > len(self.keys):
            full = self.keys != 0
            h, numbers = np.concatenate([self.keys[full], h]), np.concatenate([self.values[full], numbers])
            slots = len(self.keys)
            while 2 * len(h) > slots:
                slots *= 2
            self.keys, self.values = np.zeros(slots, np.uint64), np.zeros(slots, np.int64)
        m = np.uint64(len(self.keys) - 1)
        slot = h & m
        while len(h):
            free = self.keys[slot] == 0
            first = np.unique(slot[free], return_index=True)[1]
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.values[slot[won]] = h[won], numbers[won]
            lost = np.ones(len(h), bool)
            lost[won] = False
            h, numbers, slot = h[lost], numbers[lost], (slot[lost] + np.uint64(1)) & m


#: Classes of bytes: letters, digits, white space, marks; 0 leaves the fast way.
LETTER, DIGIT, SPACE, MARK = 1, 2, 3, 4


def byte_classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[33:127] = MARK
    table[48:58] = DIGIT
    table[65:91] = table[97:123] = LETTER
    table[[9, 10, 13, 32]] = SPACE
    table[0xC3] = table[0x80:0xC0] = LETTER  # U+00C0 to U+00FF; see plain()
    return table


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer file.

    Pieces are found on the bytes of many texts at once, by the rules of the
    tokenizer's pattern: contractions; runs of letters, digits or marks with
    one blank before them; white space, of which the last character stands
    alone or joins what follows.  Each distinct piece is encoded once: one of
    up to 16 bytes is looked up by a hash and compared with the bytes that are
    kept there, a longer one is a key of a dictionary.  When there are too
    many, those met again since the last time stay and the others go.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.classes = byte_classes()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        before = rules.get("pre_tokenizer") or {}
        # the rules of ``cut`` are those of a byte-level tokenizer's own pattern, nothing before or around it
        self.known = (rules.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                      and not before.get("add_prefix_space", True) and rules.get("truncation") is None and rules.get("padding") is None)
        self.hasher = WordHasher(np.zeros(256, bool), fold=False)
        self.clear()

    def clear(self) -> None:
        self.table = PieceTable()
        self.lanes = np.zeros((2, 1 << 16), np.uint64)
        self.rare: dict[bytes, int] = {}
        self.rare_bytes = 0
        self.pool, self.filled = np.zeros(1 << 16, self.dtype), 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.again = np.zeros(1 << 16, bool)
        self.learnt = 0

    def forget(self) -> None:
        """Drop the pieces that were met once only, and half of the room at least."""
        kept = np.flatnonzero(self.again[:self.learnt] & (self.lanes[0, :self.learnt] != 0))[:REMEMBERED // 2]
        lanes, sizes, at = self.lanes[:, kept], self.sizes[kept], self.starts[kept]
        stop = np.cumsum(sizes)
        pool = self.pool[np.repeat(at - stop + sizes, sizes) + np.arange(int(sizes.sum()))]
        self.clear()
        self._room(len(kept), len(pool))
        self.pool[:len(pool)] = pool
        self.starts[:len(kept)], self.sizes[:len(kept)], self.lanes[:, :len(kept)] = stop - sizes, sizes, lanes
        self.learnt, self.filled = len(kept), len(pool)
        self.table.add(self._hash(*lanes))

    def _room(self, entries: int, ids: int) -> None:
        while ids > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while entries > len(self.starts):
            self.starts, self.sizes, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.again))
            self.lanes = np.concatenate([self.lanes, np.zeros_like(self.lanes)], axis=1)

    def _hash(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        h = mixed(one ^ np.uint64(WordHasher.BASE))
        longer = np.flatnonzero(two)
        h[longer] = mixed(h[longer] ^ two[longer])
        return h | np.uint64(1)

    def _learn(self, new: list[bytes], spaced: np.ndarray) -> None:
        """Encode pieces met for the first time; those of a blank and letters in one call."""
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
        words = int(spaced.sum())
        sizes = np.zeros(len(new), np.int64)
        flat: list[int] = []
        for a in range(0, words, 4000):
            part = order[a:min(a + 4000, words)]
            e = self.tokenizer.encode(b"".join([new[k] for k in part.tolist()]).decode(), add_special_tokens=False)
            sizes[part] = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))
            flat += e.ids
        for a in range(words, len(order), 4000):
            part = order[a:a + 4000].tolist()
            for k, e in zip(part, self.tokenizer.encode_batch([new[k].decode() for k in part], add_special_tokens=False)):
                sizes[k] = len(e)
                flat += e.ids
        self._room(self.learnt + len(new), self.filled + len(flat))
        self.pool[self.filled:self.filled + len(flat)] = flat
        self.starts[self.learnt + order] = self.filled + np.cumsum(sizes[order]) - sizes[order]
        self.sizes[self.learnt:self.learnt + len(new)] = sizes
        self.filled += len(flat)
        self.learnt += len(new)

    def plain(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts of the safe alphabet: printable ASCII, tab, line breaks and the letters from U+00C0 to U+00FF."""
        cls = self.classes[raw]
        tail = (raw >= 0x80) & (raw < 0xC0)
        lead = np.concatenate([[False], raw[:-1] == 0xC3])
        odd = (cls == 0) | (tail & (~lead | (raw == 0x97) | (raw == 0xB7)))
        bad = np.concatenate([[0], np.cumsum(odd)])
        good = bad[off[1:]] == bad[off[:-1]]
        for s in self.special:
            if bytes(raw).find(s) >= 0:
                good &= np.array([bytes(raw[a:b]).find(s) < 0 for a, b in zip(off[:-1].tolist(), off[1:].tolist())])
        return good

    def cut(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts of pieces in the bytes of whole plain texts, none of which is empty."""
        cls = self.classes[raw]
        change = np.concatenate([[True], cls[1:] != cls[:-1]])
        change[off[:-1]] = True
        runs = np.flatnonzero(change)
        ends = np.append(runs[1:], len(raw))
        blank = cls[runs] == SPACE
        final = np.isin(ends, off)
        start = change.copy()
        # what follows white space in the same text starts with the blank before it, if it is one
        inner = blank & ~final
        start[ends[inner & (raw[ends - 1] == 32)]] = False
        start[ends[inner & (ends - runs >= 2)] - 1] = True
        quotes = np.flatnonzero(raw == 39)
        if len(quotes):
            before = np.where(np.isin(quotes, off[:-1]), 0, cls[quotes - 1])
            fresh = (before != MARK) & ~((before == SPACE) & (raw[quotes - 1] == 32))
            room = off[np.searchsorted(off, quotes, "right")] - quotes
            a = raw[np.minimum(quotes + 1, len(raw) - 1)]
            b = raw[np.minimum(quotes + 2, len(raw) - 1)]
            two = fresh & (room >= 2) & np.isin(a, np.frombuffer(b"stmd", np.uint8))
            three = fresh & (room >= 3) & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
            for q, n in ((quotes[two], 2), (quotes[three], 3)):
                start[q + 1] = False
                past = q + n
                start[past[past < len(raw)]] = True
                # a letter run that goes on after the contraction starts anew; white space and marks already do
        return np.flatnonzero(start)

    def _numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each piece's number; pieces met for the first time are learnt."""
        data, size = self.hasher.padded(raw), ends - starts
        # texts of the safe alphabet hold no zero byte, so the two lanes are the piece
        one, two = self.hasher.lane(data, starts, size, 0), np.zeros(len(starts), np.uint64)
        longer = np.flatnonzero(size > 8)
        two[longer] = self.hasher.lane(data, starts[longer], size[longer], 1)
        h = self._hash(one, two)
        short = size <= 16
        at = np.where(short, self.table.find(h), -1)
        self.again[at[at >= 0]] = True
        # a piece is one run with a blank before it or none, so its second byte tells a spaced word
        spaced = (raw[starts] == 32) & (size > 1) & (self.classes[data[starts + 1]] == LETTER)
        missing = np.flatnonzero(short & (at < 0))
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            pick = missing[first]
            self.table.add(new, np.arange(self.learnt, self.learnt + len(new)))
            known = self.learnt
            whole = data.tobytes()
            self._learn([whole[a:b] for a, b in zip(starts[pick].tolist(), ends[pick].tolist())], spaced[pick])
            self.lanes[:, known:known + len(pick)] = one[pick], two[pick]
            at[missing] = self.table.find(h[missing])
        # long pieces, and such whose hash belongs to another one
        other = np.flatnonzero(~short | (self.lanes[0][at] != one) | (self.lanes[1][at] != two))
        if len(other):
            whole = data.tobytes()
            keys = [whole[a:b] for a, b in zip(starts[other].tolist(), ends[other].tolist())]
            new = {p: k for p, k in zip(keys, other.tolist()) if p not in self.rare}
            self.rare.update({p: self.learnt + k for k, p in enumerate(new)})
            self.rare_bytes += sum(map(len, new))
            if new:
                self._learn(list(new), spaced[list(new.values())])
            at[other] = [self.rare[p] for p in keys]
        return at

    def _fast(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, self.dtype), np.zeros(len(off) - 1, np.int64)
        starts = self.cut(raw, np.unique(off))
        at = self._numbers(raw, starts, np.append(starts[1:], len(raw)))
        n = self.sizes[at]
        stop = np.cumsum(n)
        ids = self.pool[np.repeat(self.starts[at] - stop + n, n) + np.arange(int(stop[-1]))]
        upto = np.concatenate([[0], stop])[np.searchsorted(starts, off)]
        return ids, np.diff(upto)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a buffer, one text after the other, and the number of each text."""
        if self.learnt > REMEMBERED or self.rare_bytes > REMEMBERED_BYTES:
            self.forget()
        good = self.plain(raw, off) if self.known else np.zeros(len(off) - 1, bool)
        if good.all():
            return self._fast(raw, off)
        n = np.diff(off)
        keep = np.repeat(good, n)
        ids, count = self._fast(raw[keep], np.concatenate([[0], np.cumsum(n[good])]))
        data = raw.tobytes()
        others = [data[a:b].decode() for a, b, g in zip(off[:-1].tolist(), off[1:].tolist(), good.tolist()) if not g]
        parts, fast = [], iter(np.split(ids, np.cumsum(count)[:-1]) if len(count) else [])
        slow = (np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype) for t in others)
        for g in good.tolist():
            parts.append(next(fast) if g else next(slow))
        return (np.concatenate(parts) if parts else ids), np.array([len(p) for p in parts], np.int64)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file: kept between tasks."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def file_system(base: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's URI."""
    return pafs.FileSystem.from_uri(base)


def shard_schema(dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Packs ids into sequences of ``length``; the last is padded with zeros under a false mask."""

    def __init__(self, sink, dtype, length: int):
        self.schema, self.length, self.dtype = shard_schema(dtype, length), length, dtype
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.count = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.count += len(ids)
        if self.count >= self.length * BATCH:
            flat = np.concatenate(self.held)
            full = len(flat) // (self.length * BATCH) * self.length * BATCH
            for a in range(0, full, self.length * BATCH):
                self._write(flat[a:a + self.length * BATCH], self.length * BATCH)
            self.held, self.count = [flat[full:]], len(flat) - full

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.out.write_batch(pa.record_batch(cols, schema=self.schema))

    def close(self) -> None:
        if self.count:
            flat = np.concatenate(self.held)
            pad = -len(flat) % self.length
            self._write(np.concatenate([flat, np.zeros(pad, self.dtype)]), len(flat))
        self.out.close()


def write_shards(docs: DataFrame, tokenizer_path: str, base: str | None = None, *, length: int = LENGTH, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Encode and write; returns the folder and its manifest (shard, docs, tokens).

    Documents go in ascending id, null ids first, equal ids by text.  Null and
    empty texts are the end id alone.  Every row is a document, repeated rows
    too; other columns are not read.  An empty table writes no shard.  A very
    long text is encoded whole, by its own task, and may span many sequences.

    A shard holds some SHARD_BYTES of text, so their number grows with the
    table; rows of one id (a null id too) are split by the beginnings of their
    texts.
    """
    spark = docs.sparkSession
    base = base or fresh_path(spark, "tokens")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, enc, writer = f"shard-{task.partitionId():06d}", None, None
        counts: list[np.ndarray] = []
        ids: list[pa.Array] = []
        for batch in batches:
            if not len(batch):
                continue
            if writer is None:
                enc = encoder(tokenizer_path)
                files, folder = file_system(base)
                files.create_dir(folder, recursive=True)
                tmp = f"{folder}/.{name}-{task.taskAttemptId()}"
                sink = files.open_output_stream(tmp)
                writer = ShardWriter(sink, enc.dtype, length)
            for _, _, data, own in pieces(*utf8(batch.column(1))):
                flat, n = enc.encode(data, own)
                writer.add(np.insert(flat, np.cumsum(n), end_id))
                counts.append(n + 1)
            ids.append(batch.column(0))
        if writer is not None:
            writer.close()
            sink.close()
            n = np.concatenate(counts)
            with files.open_output_stream(tmp + ".docs") as side:
                table = pa.table({"doc_id": pa.concat_arrays(ids), "n_tokens": pa.array(n, pa.int64())})
                with pa.ipc.new_file(side, table.schema) as out:
                    out.write_table(table)
            files.move(tmp, f"{folder}/{name}.arrow")
            files.move(tmp + ".docs", f"{folder}/{name}.docs.arrow")
            yield pa.record_batch([pa.array([name]), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["shard", "docs", "tokens"])
        trim()

    body = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    total = body.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    ordered = body.repartitionByRange(parts, "doc_id", F.substring("text", 1, 24)).sortWithinPartitions("doc_id", "text")
    return base, stored(ordered.mapInArrow(rows, "shard string, docs long, tokens long"), "manifest")


def read_sequences(base: str, shard: str) -> pa.ipc.RecordBatchFileReader:
    """Random access to a shard's batches; a local file is mapped, not read."""
    files, folder = file_system(base)
    if isinstance(files, pafs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(f"{folder}/{shard}.arrow"))
    return pa.ipc.open_file(files.open_input_file(f"{folder}/{shard}.arrow"))


def read_documents(base: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files.

    ``start`` counts the ids of all documents before it, in all shards.  An
    empty manifest gives no rows.
    """
    # a row a shard: the window's one task has as many rows as there are files
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("start"))
    shards = shards.repartition(max(1, manifest.count()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, folder = file_system(base)
                with files.open_input_file(f"{folder}/{shard}.docs.arrow") as f:
                    index = pa.ipc.open_file(f).read_all()
                n = index["n_tokens"].to_numpy()
                bounds = np.concatenate([[0], np.cumsum(n)])
                sequences = read_sequences(base, shard)
                crc = np.zeros(len(n), np.int64)
                at, k = 0, 0
                for b in range(sequences.num_record_batches):
                    part = sequences.get_batch(b)
                    ids = part.column("ids").flatten().to_numpy()
                    mask = part.column("mask").flatten().to_numpy(zero_copy_only=False)
                    flat = ids[mask].astype("<u4")
                    raw = memoryview(flat).cast("B")
                    end = at + len(flat)
                    while k < len(n) and bounds[k] < end:
                        lo, hi = max(bounds[k], at) - at, min(bounds[k + 1], end) - at
                        crc[k] = zlib.crc32(raw[4 * lo:4 * hi], int(crc[k]))
                        if bounds[k + 1] > end:
                            break
                        k += 1
                    at = end
                yield pa.record_batch([index["doc_id"].combine_chunks(), pa.array(start + bounds[:-1]), pa.array(n), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written to Arrow files and read back."""
    return read_documents(*write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()))
