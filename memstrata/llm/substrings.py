"""Removal of repeated substrings by content-chosen anchors and hash grouping.

This stands in place of prefix doubling: there are no ranks, no sort by Spark
at growing offsets and no reranking loop. In every run of ``LENGTH`` bytes the
content itself chooses the ``NAME``-byte string with the least hash, its
anchor. Equal runs have equal anchors at equal places. Three groupings by hash
bucket, at fixed widths: the strings at anchors, where names that are unique
are dropped; the survivors' surroundings, up to ``LENGTH`` bytes on either
side together, where equal surroundings settle all runs inside them at once;
single runs of ``LENGTH`` bytes where surroundings differ. Spark deals names
out by ``hash % buckets`` and each task groups its buckets in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_buffers

LENGTH = 50
NAME = 20
BACK = LENGTH - NAME             # a run starts at most so many bytes before its anchor
AROUND = BACK + LENGTH
SEGMENT = 1 << 19                # windows that are hashed at once
HELD_NAMES = 900_000             # anchors that a task holds before it sends them
HELD_CONTEXTS = 200_000
BUCKET_BYTES = 12 << 20
NO_ID = np.iinfo(np.int64).max   # rows without an id come after all others
K = np.random.default_rng(5).integers(1, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
BYTE = np.random.default_rng(6).integers(0, 1 << 63, 256, np.uint64)


CLOSE = pa.Codec("zstd", compression_level=5)


def packed(**arrays: np.ndarray) -> bytes:
    """Arrays of one length in one compressed value; ascending ones as differences."""
    n = len(next(iter(arrays.values())))
    parts = [np.int64(n).tobytes()]
    for a in arrays.values():
        a = np.ascontiguousarray(a)
        parts.append((np.diff(a, prepend=a.dtype.type(0)) if a.dtype.kind in "iu" and a.ndim == 1 else a).tobytes())
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + CLOSE.compress(raw, asbytes=True)


def unpacked(data: bytes, **kinds: str) -> dict[str, np.ndarray]:
    raw = CLOSE.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, {}
    for name, kind in kinds.items():
        kind = np.dtype(kind)
        a = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
        out[name] = np.cumsum(a, dtype=kind) if kind.kind in "iu" else a
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * K[0]
    return h ^ (h >> np.uint64(29))


def names(data: np.ndarray) -> np.ndarray:
    """A hash of the ``NAME`` bytes from each position, by doubling: 1, 2, 4, 8, 16 bytes, and 4 more."""
    h = BYTE[data]
    four = None
    for turn, step in enumerate((1, 2, 4, 8)):
        h = h[:-step] * K[1 + turn] + h[step:]
        if step == 2:
            four = h
    return mixed(h[:len(data) - NAME + 1] * K[6] + four[16:16 + len(data) - NAME + 1])


def anchors(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, names) of the anchors of all runs that lie in one text; texts are ``data[offsets[i]:offsets[i + 1]]``."""
    run = np.ones(len(data) + 1, bool)
    ends = offsets[1:]
    for back in range(1, LENGTH):                # no run starts in the last bytes of a text
        at = ends - back
        run[at[at >= offsets[:-1]]] = False
    first, last = int(offsets[0]), int(offsets[-1])
    previous = -1
    for start in range(first, last - LENGTH + 1, SEGMENT):
        stop = min(start + SEGMENT, last - LENGTH + 1)
        h = names(data[start:stop + LENGTH - 1])
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[:stop - start], least[BACK + 1 - 16:][:stop - start])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[run[start:stop]]
        if len(at):
            at = at[np.r_[True, at[1:] != at[:-1]]]
            if at[0] + start == previous:
                at = at[1:]
        if len(at):
            previous = int(at[-1]) + start
            yield at + start, h[at]


def order_ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("doc_id").fill_null(int(NO_ID)), np.int64)


def lists(flat: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The parts of ``flat`` that start at ``cuts``."""
    return pa.ListArray.from_arrays(pa.array(np.append(cuts, len(flat)), pa.int32()), pa.array(flat, kind))


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the sorted keys begins."""
    if not len(keys[0]):
        return np.zeros(0, int)
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.r_[True, new])


def least_of(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each entry the least id among the entries of its key."""
    if not len(keys):
        return ids
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    out = np.empty_like(ids)
    out[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.r_[starts, len(keys)]))
    return out


def greatest_of(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return -least_of(keys, -ids)


SENT = "bucket int, kind int, data binary"


def rows_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                       pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "data"])


def split_name(h: np.ndarray, buckets: int) -> dict[str, np.ndarray]:
    """40 bits of a name beside those that its bucket tells; one that is shared by chance is told apart in the next round."""
    rest = h // np.uint64(buckets)
    return {"low": (rest & np.uint64(0xFFFFFFFF)).astype("<u4").view("V4"), "high": ((rest >> np.uint64(32)) & np.uint64(0xFF)).astype("u1").view("V1")}


def named_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Round one in the tasks of the scan: anchors by bucket of their name.

    A task sends a name once, for its smallest document; other documents of
    the task that have it are known to share it, and their places are passed
    on as shared, in buckets by document. A string that stands in a third of
    all documents is thus sent to its own bucket once per task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            data, offsets = text_buffers(batch, "text")
            ids, joins = order_ids(batch), np.asarray(batch.column("join_key"), np.int64)
            for at, h in anchors(data, offsets):
                text = np.searchsorted(offsets, at, "right") - 1
                held.append((h, ids[text], joins[text], at - offsets[text]))
                size += len(at)
                if size >= HELD_NAMES:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    def send(held) -> pa.RecordBatch:
        h, ids, joins, at = (np.concatenate(x) for x in zip(*held))
        least, most = least_of(h, ids), greatest_of(h, ids)
        shared, mine = least != most, ids == least
        rows = []
        by_name = (h % np.uint64(buckets)).astype(np.int64)
        by_text = (mixed(joins.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)    # what is settled needs no other place of its name
        for kind, chosen, bucket in ((0, mine, by_name), (1, shared, by_text)):
            order = np.lexsort((at[chosen], joins[chosen], bucket[chosen]))
            b, i, j, a, n = (x[chosen][order] for x in (bucket, ids, joins, at, h))
            cuts = starts_of(b)
            for lo, hi in zip(cuts, np.append(cuts[1:], len(b))):
                part = {"join": j[lo:hi], "more": (i - j)[lo:hi], "at": a[lo:hi].astype("<u8")}
                rows.append((int(b[lo]), kind, packed(**part, **split_name(n[lo:hi], buckets)) if kind == 0 else packed(**part)))
        return rows_of(rows)

    return docs.select("doc_id", "join_key", "text").mapInArrow(run, SENT)


def shared_places(part: pa.Table) -> pa.Table:
    """Places of anchors whose name occurs in several documents, by document."""
    joins, at, sent = [], [], []
    for kind, data in zip(part.column("kind").to_pylist(), part.column("data").to_pylist()):
        if kind:
            x = unpacked(data, join="<i8", more="<i8", at="<u8")
            joins.append(x["join"])
            at.append(x["at"])
        else:
            sent.append(unpacked(data, join="<i8", more="<i8", at="<u8", low="V4", high="V1"))
    if sent:
        h = np.concatenate([x["low"].view("<u4").astype(np.uint64) | (x["high"].view("u1").astype(np.uint64) << np.uint64(32)) for x in sent])
        i = np.concatenate([x["join"] + x["more"] for x in sent])
        shared = least_of(h, i) != greatest_of(h, i)
        joins.append(np.concatenate([x["join"] for x in sent])[shared])
        at.append(np.concatenate([x["at"] for x in sent])[shared])
    joins, at = np.concatenate(joins), np.concatenate(at)
    order = np.lexsort((at, joins))
    joins, at = joins[order], at[order]
    cuts = starts_of(joins)
    return pa.table({"of_key": pa.array(joins[cuts], pa.int64()), "places": lists(at.astype(np.int32), cuts, pa.int32())})


CONTEXT = {"id": "<i8", "key": "<i8", "at": "<u8", "left": "<u1", "right": "<u1"}


def valid_runs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bit o is set where the run that starts o bytes before the anchor lies in the text."""
    mask = np.zeros(len(left), np.uint32)
    for o in range(BACK + 1):
        mask |= ((left >= o) & (right >= LENGTH - o)).astype(np.uint32) << np.uint32(o)
    return mask


def sent_contexts(docs: DataFrame, buckets: int) -> DataFrame:
    """Round two in the tasks of the scan: surroundings of shared anchors, by bucket of the anchor's name.

    Of equal surroundings in a task only those of its smallest document are
    sent; the runs of the others are repeated for sure (kind 1) and go to
    buckets by document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = text_buffers(batch, "text")
            ids, keys = order_ids(batch), np.asarray(batch.column("text_key"), np.int64)
            places = batch.column("places")
            ends, flat = np.asarray(places.offsets), np.asarray(places.values)
            for row in range(batch.num_rows):
                body = data[offsets[row]:offsets[row + 1]]
                at = np.unique(flat[ends[row]:ends[row + 1]]).astype(np.int64)
                at = at[at + NAME <= len(body)]
                for lo in range(0, len(at), HELD_CONTEXTS):
                    part = at[lo:lo + HELD_CONTEXTS]
                    first, last = max(0, int(part[0]) - BACK), min(len(body), int(part[-1]) + LENGTH)
                    padded = np.zeros(last - first + AROUND, np.uint8)
                    padded[BACK:BACK + last - first] = body[first:last]
                    held.append((np.lib.stride_tricks.sliding_window_view(padded, AROUND)[part - first],
                                 np.full(len(part), ids[row]), np.full(len(part), keys[row]), part.astype(np.uint64),
                                 np.minimum(part, BACK).astype(np.uint8), np.minimum(len(body) - part, LENGTH).astype(np.uint8)))
                    size += len(part)
                    if size >= HELD_CONTEXTS:
                        yield send(held)
                        held, size = [], 0
        if held:
            yield send(held)

    def send(held) -> pa.RecordBatch:
        around, ids, keys, at, left, right = (np.concatenate(x) for x in zip(*held))
        mine = ids == least_of(whole_name(around, left, right), ids)
        rows = []
        name = name_of(around)
        by_name = (name % np.uint64(buckets)).astype(np.int64)
        by_text = (mixed(ids.view(np.uint64) ^ keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        masks = valid_runs(left, right)
        for kind, chosen, bucket in ((0, mine, by_name), (1, ~mine, by_text)):
            places = np.flatnonzero(chosen)
            order = places[np.lexsort((at[places], ids[places], bucket[places]))]
            b = bucket[order]
            cuts = starts_of(b)
            for lo, hi in zip(cuts, np.append(cuts[1:], len(b))):
                o = order[lo:hi]
                own = {"id": ids[o], "key": keys[o], "at": at[o]}
                own |= {"left": left[o], "right": right[o], "around": np.ascontiguousarray(around[o])} if kind == 0 else {"mask": masks[o]}
                rows.append((int(b[lo]), kind, packed(**own)))
        return rows_of(rows)

    return docs.mapInArrow(run, SENT)


def whole_name(around: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of the surroundings, and of where they are cut off."""
    whole = np.ascontiguousarray(around).view("<u8")
    h = left.astype(np.uint64) * np.uint64(256) + right
    for k in range(whole.shape[1]):
        h = mixed(h ^ (whole[:, k] * K[k % 15 + 1]))
    return h


def name_of(around: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(around[:, BACK:BACK + NAME]).view("<u4")
    h = np.zeros(len(around), np.uint64)
    for k in range(words.shape[1]):
        h = mixed(h ^ (words[:, k].astype(np.uint64) * K[k + 1]))
    return h


def repeated_runs(part: pa.Table) -> pa.Table:
    """Last round: which runs around the anchors of a bucket also start in a smaller document."""
    out, sent = [], []
    for kind, data in zip(part.column("kind").to_pylist(), part.column("data").to_pylist()):
        if kind:
            x = unpacked(data, id="<i8", key="<i8", at="<u8", mask="<u4")
            out.append((x["id"], x["key"], x["at"], x["mask"]))
        else:
            sent.append(unpacked(data, **CONTEXT, around=f"V{AROUND}"))
    if sent:
        ids, keys, at, left, right = (np.concatenate([x[c] for x in sent]) for c in CONTEXT)
        around = np.concatenate([x["around"] for x in sent]).view(np.uint8).reshape(-1, AROUND)
        valid, mask = valid_runs(left, right), np.zeros(len(ids), np.uint32)
        # equal surroundings in a smaller document settle all runs of an anchor
        first = ids == least_of(whole_name(around, left, right), ids)
        mask[~first] = valid[~first]
        # single runs matter where surroundings of one name still differ
        name = name_of(around)
        rest = np.flatnonzero(first)
        rest = rest[least_of(name[rest], ids[rest]) != greatest_of(name[rest], ids[rest])]
        parts = -(-len(rest) // HELD_CONTEXTS)
        for k in range(parts):
            some = rest[name[rest] // np.uint64(7) % np.uint64(parts) == k]
            mask[some] |= single_runs(around[some], name[some], ids[some], valid[some])
        hit = mask != 0
        out.append((ids[hit], keys[hit], at[hit], mask[hit]))
    ids, keys, at, mask = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((at, keys, ids))
    ids, keys, at, mask = ids[order], keys[order], at[order], mask[order]
    cuts = starts_of(ids, keys)
    runs = (at.astype(np.int64) << np.int64(BACK + 1)) | mask.astype(np.int64)
    return pa.table({"of": pa.array(ids[cuts], pa.int64()), "of_key": pa.array(keys[cuts], pa.int64()), "runs": lists(runs, cuts, pa.int64())})


def single_runs(around: np.ndarray, name: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The bits of the runs that also start in a smaller document. Running sums give the hash of each run as a difference."""
    sums = np.zeros((AROUND + 1, len(ids)), np.uint64)
    for k in range(AROUND):
        sums[k + 1] = sums[k] * K[7] + BYTE[around[:, k]]
    power = np.uint64(pow(int(K[7]), LENGTH, 1 << 64))
    mask = np.zeros(len(ids), np.uint32)
    for o in range(BACK + 1):
        live = np.flatnonzero(valid >> np.uint32(o) & np.uint32(1))
        start = BACK - o
        run = mixed(name[live] ^ mixed(sums[start + LENGTH][live] - sums[start][live] * power))
        mask[live[least_of(run, ids[live]) < ids[live]]] |= np.uint32(1) << np.uint32(o)
    return mask


def covered(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` bytes lie in a repeated run. A value of ``runs`` is an anchor and the bits of its runs."""
    at, mask = runs >> (BACK + 1), runs & ((1 << (BACK + 1)) - 1)
    full = mask == (1 << (BACK + 1)) - 1
    edge = np.bincount(at[full] - BACK, minlength=n + 1) - np.bincount(at[full] + LENGTH, minlength=n + 1)
    entry, bit = np.nonzero((mask[~full][:, None] >> np.arange(BACK + 1)) & 1)
    start = at[~full][entry] - bit
    edge = edge + np.bincount(start, minlength=n + 1) - np.bincount(start + LENGTH, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


REMOVED = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def find_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, removed (array of maximal spans of bytes) and kept (the bytes that remain) of each row of ``docs``.

    A byte is removed where a run of ``LENGTH`` bytes that covers it also
    starts in a document with a smaller id. Runs do not cross documents, may
    overlap, and are judged on the input. Null and empty texts have no bytes;
    rows without an id (or with 2 ** 63 - 1) come after all others, and rows of equal id do not
    remove each other's bytes; an empty table gives an empty result; further
    columns of ``docs`` are not read. Whole texts are read, of any length.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # the texts are shuffled once: both joins deal them out by join_key, and Spark reads that exchange twice
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    keyed = keyed.withColumn("join_key", F.coalesce(F.nullif("doc_id", F.lit(int(NO_ID))), "text_key"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(48, -(-total // BUCKET_BYTES)))
    found = named_anchors(keyed, buckets).groupBy("bucket").applyInArrow(shared_places, "of_key long, places array<int>")
    places = found.groupBy("of_key").agg(F.flatten(F.collect_list("places")).alias("places"))
    at_places = keyed.join(places, F.col("join_key") == F.col("of_key")).select("doc_id", "text_key", "text", "places")
    runs = sent_contexts(at_places, buckets).groupBy("bucket").applyInArrow(repeated_runs, "of long, of_key long, runs array<long>")
    runs = (runs.groupBy("of", "of_key").agg(F.flatten(F.collect_list("runs")).alias("runs"))
            .withColumn("of_join", F.when(F.col("of") == int(NO_ID), F.col("of_key")).otherwise(F.col("of"))))
    # of rows that share an id, each text takes its own runs; as no equality of keys, so that the exchange serves
    own = (F.col("text_key").bitwiseXOR(F.col("of_key")) == 0) & (F.coalesce("doc_id", F.lit(int(NO_ID))).bitwiseXOR(F.col("of")) == 0)
    cut = keyed.join(runs, (F.col("join_key") == F.col("of_join")) & own, "left").select("doc_id", "text", "runs")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(REMOVED)), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for batch in batches:
            data, offsets = text_buffers(batch, "text")
            spans, kept = [], []
            ends, flat = np.asarray(batch.column("runs").offsets), np.asarray(batch.column("runs").values)
            for row in range(batch.num_rows):
                body = data[offsets[row]:offsets[row + 1]]
                if ends[row] == ends[row + 1]:
                    spans.append([])
                    kept.append(body.tobytes())
                    continue
                gone = covered(len(body), flat[ends[row]:ends[row + 1]])
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                kept.append(body[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()),
                                              pa.array(spans, arrow.field(2).type), pa.array(kept, pa.binary())], schema=arrow)

    return cut.mapInArrow(run, schema)


def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = find_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
                        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
