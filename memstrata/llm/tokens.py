"""Token ids in patched frame-of-reference blocks.

Ids are cut into blocks. A block stores its minimum, the differences to it
packed at the width that a percentile of them needs, and the wider ones in an
exception list. A file ends with the starts of its blocks and an index of its
documents, so any document can be read from the blocks it lies in.

File: magic (8 bytes), blocks, index, trailer.
Block: minimum u32, values u32, exceptions u32, width u32; packed differences
(groups of 8 values in ``width`` bytes, low bits first); exception positions
u16; exception differences u32.
Index: block starts u64; document ids i64; validity of the ids u8; lengths u64.
Trailer: index start u64, blocks u64, documents u64, values u64, magic.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memstrata.session import durable, prefix_sums, shared_folder

from .common import slices, table, text_buffers

MAGIC = b"PFORIDS1"
BLOCK = 8192
PERCENTILE = 90
TRAILER = struct.Struct("<QQQQ8s")
HEAD = struct.Struct("<IIII")
END_ID = 0
FILE_BYTES = 64 << 20    # of text for one file
STORED_PIECES = 2_000_000
SLICE_BYTES = 1 << 20    # of text that is encoded at once
BATCH_ROWS = 1000        # that a task gets at once
STORED_LENGTH = 64       # bytes of a piece that is stored
TOGETHER = 2000          # plain pieces that the tokenizer gets as one text
#: What a byte may be: visible ASCII, an ASCII letter, an ASCII sign (no letter, no digit), or visible for sure (lead bytes that may begin a wide blank are not).
SEEN_ASCII, LETTER, SIGN, SEEN = 1, 2, 4, 8
BYTE_KIND = np.zeros(256, np.uint8)
BYTE_KIND[0x21:0x7F] = SEEN_ASCII | SEEN | SIGN
BYTE_KIND[ord("0"):ord("9") + 1] = SEEN_ASCII | SEEN
BYTE_KIND[ord("|")] = SEEN_ASCII | SEEN    # follows a letter inside the names of special tokens
BYTE_KIND[0xC3:0xF5] = SEEN
BYTE_KIND[[0xE1, 0xE2, 0xE3]] = 0
for _c in (*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)):
    BYTE_KIND[_c] = SEEN_ASCII | SEEN | LETTER
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Pieces are hashed over their bytes through this substitution; one that maps all bytes alike makes hashes collide.
BYTE_HASH = np.random.default_rng(21).permutation(256).astype(np.uint8)
#: What to keep of 8 bytes when a piece has only the first 0 to 8 of them.
FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


# packing

def pack(values: np.ndarray, width: int) -> bytes:
    """Values below 2 ** width, 8 of them in ``width`` bytes."""
    if not width or not len(values):
        return b""
    rows = np.zeros((-(-len(values) // 8), 8), np.uint64)
    rows.ravel()[:len(values)] = values
    # 8 values are a number of 8 * width bits, held in words of 64
    words = np.zeros((len(rows), -(-width // 8)), np.dtype("<u8"))
    for i in range(8):
        word, shift = divmod(i * width, 64)
        words[:, word] |= rows[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= rows[:, i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.view(np.uint8)[:, :width]).tobytes()


def unpack(data: bytes | memoryview, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint32)
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.empty((len(raw), 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(8):
        first, last = i * width // 8, (i * width + width - 1) // 8
        word = np.zeros(len(raw), np.uint64)
        for k in range(first, last + 1):
            word |= raw[:, k].astype(np.uint64) << np.uint64(8 * (k - first))
        out[:, i] = (word >> np.uint64(i * width % 8)) & mask
    return out.ravel()[:n]


def encode_block(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    low = int(ids.min())
    gaps = ids.astype(np.uint32) - np.uint32(low)
    place = min(len(gaps) - 1, (len(gaps) * percentile + 99) // 100 - 1)
    width = int(np.partition(gaps, place)[place]).bit_length()
    over = np.flatnonzero(gaps >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    kept = gaps.copy()
    kept[over] = 0
    return (HEAD.pack(low, len(gaps), len(over), width) + pack(kept, width)
            + over.astype("<u2").tobytes() + gaps[over].astype("<u4").tobytes())


def decode_block(data: bytes | memoryview) -> np.ndarray:
    low, n, exceptions, width = HEAD.unpack_from(data)
    at = HEAD.size
    size = -(-n // 8) * width
    out = unpack(data[at:at + size], n, width).copy()
    at += size
    places = np.frombuffer(data[at:at + 2 * exceptions], "<u2")
    out[places] = np.frombuffer(data[at + 2 * exceptions:at + 6 * exceptions], "<u4")
    return out + np.uint32(low)


# files

class Writer:
    """Writes one file; ids are given document by document."""

    def __init__(self, sink, block: int = BLOCK, percentile: int = PERCENTILE) -> None:
        self.sink, self.block, self.percentile = sink, block, percentile
        self.at, self.held, self.waiting = len(MAGIC), 0, []
        self.starts: list[int] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 16 * self.block:
            self.flush(False)

    def flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        stop = len(ids) if all_of_it else len(ids) - len(ids) % self.block
        for i in range(0, stop, self.block):
            data = encode_block(ids[i:min(i + self.block, stop)], self.percentile)
            self.starts.append(self.at)
            self.sink.write(data)
            self.at += len(data)
        self.waiting, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> int:
        self.flush(True)
        total = int(sum(self.lengths))
        for part in (np.array(self.starts, "<u8"), np.array([i or 0 for i in self.ids], "<i8"),
                     np.array([i is not None for i in self.ids], "u1"), np.array(self.lengths, "<u8")):
            self.sink.write(part.tobytes())
        self.sink.write(TRAILER.pack(self.at, len(self.starts), len(self.ids), total, MAGIC))
        return total


def read_file(source, size: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the file, ids) of each document, block after block."""
    source.seek(size - TRAILER.size)
    index, blocks, documents, _, magic = TRAILER.unpack(source.read(TRAILER.size))
    if magic != MAGIC:
        raise ValueError("not a file of packed ids")
    source.seek(index)
    starts = np.frombuffer(source.read(8 * blocks), "<u8")
    ids = np.frombuffer(source.read(8 * documents), "<i8")
    valid = np.frombuffer(source.read(documents), "u1")
    lengths = np.frombuffer(source.read(8 * documents), "<u8")
    ends = np.append(starts[1:], index).astype(np.int64)
    source.seek(len(MAGIC))
    held, block, at = np.zeros(0, np.uint32), 0, 0
    for i in range(documents):
        n, parts = int(lengths[i]), [held]
        have = len(held)
        while have < n:
            parts.append(decode_block(source.read(int(ends[block]) - int(starts[block]))))
            have += len(parts[-1])
            block += 1
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield (int(ids[i]) if valid[i] else None), at, held[:n]
        held, at = held[n:], at + n


# tokenizing

class Encoder:
    """Ids of whole texts, piece by piece.

    The tokenizer's own rule starts a new pre-token at each space that a
    visible character follows, at a sign after a letter, and on both sides of
    a line feed between a visible character and a letter. What stands between such places does not influence each
    other, so texts are cut there (leaving out a place is always safe), and
    each different piece is given to the tokenizer once. Pieces are kept in an
    open-addressed table of arrays, found by a hash and confirmed byte by
    byte; the table has a bound and is emptied when it is full.
    """

    def __init__(self, file: str, most: int = STORED_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(file)
        #: a token's characters stand for one byte each
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of_id = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of_id[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.most, self.mask = most, np.uint64((1 << (2 * most - 1).bit_length()) - 1)
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(int(self.mask) + 1, np.uint64), np.zeros(int(self.mask) + 1, np.int32)
        #: of each stored piece: where its ids and its bytes start (with the end after the last)
        self.id_starts, self.byte_starts = Grown(np.int64, 0), Grown(np.int64, 0)
        self.ids, self.bytes, self.used = Grown(np.uint32), Grown(np.uint8), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The stored piece of each hash, or -1."""
        out, slot, open_ = np.full(len(h), -1, np.int32), h & self.mask, np.arange(len(h))
        while len(open_):
            key = self.keys[slot]
            hit = key == h[open_]
            out[open_[hit]] = self.slots[slot[hit]]
            go = ~hit & (key != 0)
            open_, slot = open_[go], (slot[go] + np.uint64(1)) & self.mask
        return out

    def put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Store new, different hashes."""
        slot, open_ = h & self.mask, np.arange(len(h))
        while len(open_):
            free = self.keys[slot] == 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.slots[slot[won]] = h[open_[won]], numbers[open_[won]]
            go = np.ones(len(open_), bool)
            go[won] = False
            open_, slot = open_[go], (slot[go] + np.uint64(1)) & self.mask

    def learn(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Append pieces with their ids; gives the number of each.

        A space and letters is a pre-token wherever it stands, so such pieces
        are encoded many in one text. Ids stand for bytes, whose number tells
        where the next piece begins.
        """
        kept = len(self.id_starts) - 1
        held, ends = gathered(data, starts, lengths), np.cumsum(lengths)
        begins = ends - lengths
        fits = letters(held)
        fits[begins] = held[begins] == 32
        simple = np.logical_and.reduceat(fits, begins) & (lengths > 1) & (lengths <= STORED_LENGTH)
        order = np.r_[np.flatnonzero(simple), np.flatnonzero(~simple)]
        number = np.empty(len(starts), np.int32)
        number[order] = np.arange(kept, kept + len(order))
        plain = int(simple.sum())
        held, ends = gathered(held, begins[order], lengths[order]), np.cumsum(lengths[order])
        cuts = [*range(0, plain, TOGETHER), plain] if plain else []
        at = [0, *ends.tolist()]
        raw = held.tobytes()
        texts = [raw[at[i]:at[j]].decode() for i, j in zip(cuts, cuts[1:])]
        texts += [raw[i:j].decode() for i, j in zip(at[plain:], at[plain + 1:])]
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        together = max(0, len(cuts) - 1)
        ids = np.fromiter(chain.from_iterable(lists), np.uint32)
        alone = np.array([len(x) for x in lists[together:]], np.int64)
        first = ids[:len(ids) - int(alone.sum())]
        spent = np.cumsum(self.bytes_of_id[first])
        stop = np.searchsorted(spent, ends[:plain]) + 1
        if plain and not (len(spent) == stop[-1] and np.array_equal(spent[stop - 1], ends[:plain])):
            raise ValueError("the tokenizer does not start a pre-token at a space before letters")
        self.id_starts.add(self.id_starts.last() + np.r_[stop, len(first) + np.cumsum(alone)])
        self.byte_starts.add(self.byte_starts.last() + ends)
        self.ids.add(ids)
        self.bytes.add(held)
        return number

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has) of texts in one buffer of bytes."""
        if len(self.id_starts) > self.most:
            self.clear()
        data, offsets = np.append(data[offsets[0]:offsets[-1]], np.zeros(8, np.uint8)), offsets - offsets[0]
        starts, lengths, h = pieces_of(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        short = lengths <= STORED_LENGTH
        which = np.full(len(starts), -1, np.int32)
        which[short] = self.find(h[short])
        self.confirm(data, starts, lengths, which)
        new = np.flatnonzero(which < 0)
        if len(new):
            # short pieces once each, long ones each time; none of the long ones is kept
            once, back = np.unique(np.where(short[new], h[new], np.uint64(0)), return_inverse=True)
            first = np.full(len(once), -1)
            first[back[::-1]] = new[::-1]
            lead = new == first[back]
            alone = ~short[new] | ~self.equal(data, starts, lengths, new, first[back])
            chosen = np.r_[new[lead & ~alone], new[alone]]
            which[chosen] = self.learn(data, starts[chosen], lengths[chosen])
            rest = ~lead & ~alone
            which[new[rest]] = which[first[back[rest]]]
            stored = new[lead & ~alone]
            stored = stored[self.find(h[stored]) < 0][:self.most - self.used]
            self.put(h[stored], which[stored])
            self.used += len(stored)
        begin = self.id_starts.view()[which]
        count = self.id_starts.view()[which + 1] - begin
        ends = np.cumsum(count)
        ids = self.ids.view()[np.repeat((begin - (ends - count)).astype(np.int32), count) + np.arange(ends[-1], dtype=np.int32)]
        upto = np.r_[0, ends][np.searchsorted(starts, offsets)]
        return ids, np.diff(upto)

    def equal(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b have the same bytes."""
        return same_bytes(data, starts[a], data, starts[b], lengths[a], lengths[b])

    def confirm(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> None:
        """Take back what was found by its hash but has other bytes."""
        found = np.flatnonzero(which >= 0)
        begin = self.byte_starts.view()
        piece = which[found]
        stored = begin[piece]
        same = same_bytes(data, starts[found], self.bytes.held, stored, lengths[found], begin[piece + 1] - stored)
        which[found[~same]] = -1


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number."""
    return np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))


def same_bytes(one: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether ``n`` bytes from ``a`` on in one buffer are the ``m`` from ``b`` on in another; both have 8 to spare."""
    same = n == m
    x, y = eights(one), eights(other)
    open_ = np.flatnonzero(same & (n > 0))
    at = 0
    while len(open_):
        equal = (x[a[open_] + at] ^ y[b[open_] + at]) & FIRST_BYTES[np.minimum(n[open_] - at, 8)] == 0
        same[open_[~equal]] = False
        at += 8
        open_ = open_[equal & (n[open_] > at)]
    return same


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of pieces, one after the other."""
    return data[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]


def letters(b: np.ndarray) -> np.ndarray:
    """Which bytes belong to an ASCII or Latin-1 letter."""
    wide = (b[:-1] == 0xC3) & (b[1:] != 0x97) & (b[1:] != 0xB7)
    out = BYTE_KIND[b] & LETTER > 0
    out[:-1] |= wide
    out[1:] |= wide
    return out


class Grown:
    """An array that grows at its end."""

    SPARE = 8

    def __init__(self, kind, *first) -> None:
        self.held, self.size = np.zeros(1024, kind), 0
        self.add(np.array(first, kind))

    def __len__(self) -> int:
        return self.size

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) + self.SPARE > len(self.held):
            self.held = np.concatenate([self.held[:self.size], np.zeros(max(self.size, 2 * len(more)) + self.SPARE, self.held.dtype)])
        self.held[self.size:self.size + len(more)] = more
        self.size += len(more)

    def view(self) -> np.ndarray:
        return self.held[:self.size]

    def last(self) -> int:
        return int(self.held[self.size - 1])


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, hashes) of the pieces of texts ``data[offsets[i]:offsets[i + 1]]``; hashes are those of short pieces.

    The texts lie from 0 on, and 8 more bytes follow them.
    """
    b = data[:int(offsets[-1])]
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kind, letter = BYTE_KIND[b], letters(b)
    first, last = letter & ((b < 128) | (b == 0xC3)), letter & (b != 0xC3)
    # what stands after and before, nothing at the borders of a text
    inner = offsets[(offsets > 0) & (offsets < len(b))]
    after, then, before, prior = np.r_[kind[1:], np.uint8(0)], np.r_[first[1:], False], np.r_[np.uint8(0), kind[:-1]], np.r_[False, last[:-1]]
    after[inner - 1], then[inner - 1], before[inner], prior[inner] = 0, False, 0, False
    line = (b == 10) & ((before & SEEN_ASCII > 0) | prior) & then
    cut = ((b == 32) & (after & SEEN > 0)) | ((kind & SIGN > 0) & prior) | line
    cut[1:] |= line[:-1]
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(cut)
    lengths = np.diff(np.r_[starts, len(b)])
    numbers = eights(BYTE_HASH.astype(np.uint8)[data])
    h = (lengths.astype(np.uint64) ^ (numbers[starts] & FIRST_BYTES[np.minimum(lengths, 8)]) * ODD)
    for at in range(8, STORED_LENGTH, 8):
        more = np.flatnonzero(lengths > at)
        if not len(more):
            break
        x = h[more]
        h[more] = ((x ^ (x >> np.uint64(31))) * ODD) ^ (numbers[starts[more] + at] & FIRST_BYTES[np.minimum(lengths[more] - at, 8)])
    h = (h ^ (h >> np.uint64(32))) * ODD
    h ^= h >> np.uint64(29)
    return starts, lengths, np.where(h == 0, np.uint64(1), h)


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One encoder in each Python worker."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


# Spark

def write_files(docs: DataFrame, tokenizer_file: str, path: str | None = None, text: str = "text", doc_id: str = "doc_id",
                end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Tokenize and write; gives the manifest as a written table: (number, file, documents, ids), ``number`` being the order of the files.

    Documents are dealt by ranges of (id, hash of the text) and sorted in each
    range, so the files in order hold ascending ids, null first; equal ids are
    split over files if there are many. A null text counts as an empty one,
    and every document ends with ``end_id``. An empty table gives no file.
    Each attempt of a task writes a file of its own into the shared folder,
    and the manifest names those of the attempts that succeeded: a lost
    executor leaves a file that nobody reads.
    """
    import pyarrow.fs
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/memstrata/{spark.sparkContext.applicationId}/ids-{uuid.uuid4().hex}"
    filesystem, folder = pyarrow.fs.FileSystem.from_uri(path)
    filesystem.create_dir(folder, recursive=True)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(body) + 64)).first()[0] or 0
    files = int(max(1, -(-total // file_bytes), min(64, total // (4 << 20))))
    picked = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"))
    # ties of the id, and the nulls, are split by the text and a number that differs between equal texts
    tie = F.xxhash64("text", F.monotonically_increasing_id())
    ordered = picked.withColumn("tie", tie).repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file).encode
        number = TaskContext.get().partitionId()
        store, place = pyarrow.fs.FileSystem.from_uri(path)
        writer, name, sink = None, f"{place}/part-{number:06d}-{uuid.uuid4().hex}.pfor", None
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                if writer is None:
                    sink = store.open_output_stream(name)
                    writer = Writer(sink)
                ids, counts = encode(*text_buffers(batch, "text"))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                cuts = np.cumsum(counts + 1)
                for i, a, b in zip(batch.column("doc_id").to_pylist(), cuts - counts - 1, cuts):
                    writer.add(i, ids[a:b])
        if writer is not None:
            total = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"number": [number], "file": [f"{path}/{name.rsplit('/', 1)[1]}"], "documents": [len(writer.ids)], "ids": [total]})

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
    try:
        return durable(ordered.select("doc_id", "text").mapInArrow(write, "number long, file string, documents long, ids long"))
    finally:
        spark.conf.set(setting, before)


def write_ids(*args, **kwargs) -> list[tuple[int, str, int, int]]:
    """Like ``write_files``, with the manifest as a list, for a few files."""
    return sorted(tuple(r) for r in write_files(*args, **kwargs).collect())


def read_ids(spark: SparkSession, manifest: DataFrame | list[tuple[int, str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; ids are little-endian unsigned 32-bit numbers."""
    if not isinstance(manifest, DataFrame):
        manifest = spark.createDataFrame(manifest, "number long, file string, documents long, ids long")
    placed = prefix_sums(manifest, [], F.floor(F.col("number") / 1024), [F.col("number")], F.col("ids"), "before")
    files = placed.select("number", "file", "before").repartitionByRange(max(1, manifest.count()), "number")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        for batch in batches:
            for row in batch.to_pylist():
                store, place = pyarrow.fs.FileSystem.from_uri(row["file"])
                held: list[tuple] = []
                size = 0
                with store.open_input_file(place) as source:
                    for doc_id, start, ids in read_file(source, source.size()):
                        held.append((doc_id, row["before"] + start, len(ids), ids.astype("<u4").tobytes()))
                        size += 4 * len(ids)
                        if size > 4 << 20:
                            yield _rows(held)
                            held, size = [], 0
                if held:
                    yield _rows(held)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())],
                                      names=["doc_id", "start", "n_tokens", "ids"])


def op7(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    manifest = write_files(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    read = read_ids(spark, manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
