"""Suffix-array deduplication of repeated byte passages.

Every passage of ``LENGTH`` bytes that also starts earlier is removed.  The
suffix array is sparse: a passage is represented by its anchor, the ``GRAM``
bytes of smallest hash within it, so equal passages have equal anchors at equal
offsets, and consecutive passages share one (a passage run, with its context:
the bytes from its first passage's start to its last one's stop).

1. Each batch of documents drops runs whose context, compared byte by byte, it
   has met before: they are repeats.  What is left is counted by anchor; anchors
   met once are dropped.
2. The others fetch their contexts.  Sampled splitters range-partition them by
   the leading bytes of the suffix that starts at the anchor.  A bucket sorts
   these suffixes, and what stands before them read backwards, by multikey
   quicksort, and knows from neighbours' common prefixes which passages equal
   which: the earliest stays.
3. Anchors that stand in very many different contexts are split: each of their
   passages is a suffix of its own, range-partitioned at sampled splitters by
   bytes and place, sorted, and compared with the one before, across the
   boundaries of buckets too.

Hashes only choose candidates; bytes decide what goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import and_fields, dropped, named, numbered, slices, tidy, written

LENGTH = 100
GRAM = 32
#: Bytes that anchors are searched in at a time; positions in it fit in 24 bits.
SLICE = 1 << 18
#: Bytes of text for a partition, about; contexts, and passages of split anchors, in a bucket, about.
PART_BYTES, BUCKET_ROWS, BUCKET_PASSAGES = 8 << 20, 50_000, 200_000
#: An anchor's different contexts in a batch of documents, and in all, beyond which its passages are sorted each for itself.
OFTEN_HERE, OFTEN = 32, 2_000
#: Rows of an Arrow batch that are searched, and cut, at a time.
SEARCHED, ROWS = 1_000, 500
#: Kinds of marks: a run to compare, that an anchor is to be split, a run of such an anchor, a repeat (start and stop).
RUN, SPLIT, APART, REPEAT = range(4)
#: Parts below this size are sorted at once instead of being divided further.
SMALL = 4096
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CODE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class Rolling:
    """Fingerprints of any substring of a buffer: prefix sums of code * BASE**i, modulo 2**64."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Rolling.powers) < n:
            for name, base in (("powers", BASE), ("inverses", INVERSE)):
                full = np.full(n, base, np.uint64)
                full[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(full))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(CODE[data] * Rolling.powers[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        x = (self.sums[stop] - self.sums[start]) * Rolling.inverses[start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ x >> np.uint64(32)


def passage_runs(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """The passage runs of texts that stand one after another in ``data``.

    owner: index of the text; first: where its first passage starts; off: of the
    anchor from there; count: of passages; h and c: hashes of anchor and context.
    """
    out: list[tuple[np.ndarray, ...]] = []
    width, total = length - gram + 1, len(data) - length + 1
    for a in range(0, total, SLICE):
        n = min(SLICE, total - a)
        roll = Rolling(data[a : a + n + length - 1])
        at = np.arange(n + width - 1)
        h = roll.of(at, at + gram)
        low, step = (h >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64), 1
        while 2 * step <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[:n], low[width - step : width - step + n])
        owner = np.searchsorted(ends, a + np.arange(n), side="right")
        starts = np.flatnonzero(a + np.arange(n) + length <= ends[owner])
        if not len(starts):
            continue
        place, owner = (low[starts] & np.uint64((1 << 24) - 1)).astype(np.int64), owner[starts]
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
        count, first = np.diff(np.append(new, len(starts))), starts[new]
        out.append((owner[new], a + first, place[new] - first, count, h[place[new]], roll.of(first, first + count - 1 + length)))
    names = ("owner", "first", "off", "count", "h", "c")
    if not out:
        return dict(zip(names, (np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 2), strict=True))
    return dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True))


def same_bytes(data: np.ndarray, one: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from each of ``one`` equal those from the matching ``other``; sizes over 0."""
    out = np.zeros(len(one), bool)
    for a in range(0, len(one), 1 << 12):
        n = size[a : a + (1 << 12)]
        begin = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(begin, n)
        equal = data[np.repeat(one[a : a + len(n)], n) + step] == data[np.repeat(other[a : a + len(n)], n) + step]
        out[a : a + len(n)] = np.logical_and.reduceat(equal, begin)
    return out


def merged(start: np.ndarray, stop: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Maximal runs that spans cover, and whose they are; spans of different owners stay apart (their places must follow their owners)."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order]) if len(order) else stop
    owner = np.zeros(len(order), np.int64) if owner is None else owner[order]
    cut = np.flatnonzero((start[1:] > stop[:-1]) | (owner[1:] != owner[:-1]))
    first, last = (np.append(0, cut + 1), np.append(cut, len(start) - 1)) if len(start) else (order, order)
    return start[first], stop[last], owner[first]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column one after another, without a copy, and where each value ends; null has none."""
    _, places, held = column.buffers()
    ends = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, ends[1:] - ends[0]


def marks_of(ids: np.ndarray, column: pa.Array, length: int, gram: int) -> list[np.ndarray]:
    """h, salt, kind, _id, a, b of a batch: of runs to compare a is first << 16 | off << 8 | count, of repeats a and b are start and stop.

    Runs of an anchor with many contexts here carry the batch's salt, so that no task gets all of them.
    """
    data, ends = laid_out(column)
    r = passage_runs(data, ends, length, gram)
    begin = ends - np.diff(ends, prepend=0)
    order = np.lexsort((r["first"], ids[r["owner"]], r["c"]))
    r = {k: x[order] for k, x in r.items()}
    again = np.flatnonzero((r["c"][1:] == r["c"][:-1]) & (r["count"][1:] == r["count"][:-1]) & (r["off"][1:] == r["off"][:-1])) + 1
    again = again[same_bytes(data, r["first"][again - 1], r["first"][again], r["count"][again] + length - 1)]
    stop = r["first"] + r["count"] + length - 1
    start, stop, owner = merged(r["first"][again], stop[again], r["owner"][again])
    repeats = [signed(start.astype(np.uint64) * BASE), np.full(len(start), -1), np.full(len(start), REPEAT), ids[owner], start - begin[owner], stop - begin[owner]]
    head = np.ones(len(r["c"]), bool)
    head[again] = False
    r = {k: x[head] for k, x in r.items()}
    keys, at, n = np.unique(r["h"], return_inverse=True, return_counts=True)
    many = n > OFTEN_HERE
    salt = int(ids[0]) % 0x7FFFFFFF + 1 if len(ids) else 0
    loc = (r["first"] - begin[r["owner"]]) << 16 | r["off"] << 8 | r["count"]
    runs = [signed(r["h"]), np.where(many[at], salt, 0), np.where(many[at], APART, RUN), ids[r["owner"]], loc, np.zeros(len(loc), np.int64)]
    none = np.zeros(many.sum(), np.int64)
    split = [signed(keys[many]), none, none + SPLIT, none, none, none]
    return [np.concatenate(x) for x in zip(repeats, runs, split, strict=True)]


def marks(docs: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """(_id, kind, a, b) of docs(_id, t): repeats within a batch, and runs whose anchor stands elsewhere too (RUN, or APART where it is split)."""
    names = ["h", "salt", "kind", "_id", "a", "b"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SEARCHED):
            got = marks_of(batch.column("_id").to_numpy(), batch.column("t"), length, gram)
            kinds = (np.int64, np.int32, np.int32, np.int64, np.int64, np.int64)
            for at in range(0, len(got[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)].astype(k)) for x, k in zip(got, kinds, strict=True)], names)

    own = Window.partitionBy("h", "salt")
    found = docs.mapInArrow(run, "h long, salt int, kind int, _id long, a long, b long").repartition(parts, "h", "salt")
    found = found.withColumns({"n": F.count("*").over(own), "top": F.max("kind").over(own)}).where(f"kind >= {APART} or kind = {RUN} and n > 1")
    kind = F.when(F.col("kind") == REPEAT, F.lit(REPEAT)).when((F.col("top") > RUN) | (F.col("n") > OFTEN), F.lit(APART)).otherwise(F.lit(RUN))
    return found.select("_id", kind.alias("kind"), "a", "b")


def contexts(docs: DataFrame, found: DataFrame, parts: int, length: int) -> DataFrame:
    """(apart, _id, at, before, suffix) of the runs found in docs(_id, t): the anchor's place, and the context before and from it on."""
    runs = found.where(f"kind <> {REPEAT}").select("_id", F.struct("kind", "a").alias("run")).repartition(parts, "_id")
    runs = runs.groupBy("_id").agg(F.collect_list("run").alias("runs"))
    both = docs.repartition(parts, "_id").join(runs.hint("shuffle_hash"), "_id")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["apart", "_id", "at", "before", "suffix"]
        for whole in batches:
            for k in range(whole.num_rows):
                text, held = whole.column("t")[k].as_py(), whole.column("runs")[k].values
                loc = held.field("a").to_numpy()
                first, off, count = loc >> 16, loc >> 8 & 255, loc & 255
                at, stop = first + off, first + count + length - 1
                before = pa.array([text[s:e] for s, e in zip(first.tolist(), at.tolist(), strict=True)], pa.binary())
                suffix = pa.array([text[s:e] for s, e in zip(at.tolist(), stop.tolist(), strict=True)], pa.binary())
                ids = np.full(len(loc), whole.column("_id")[k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(held.field("kind").to_numpy() == APART), pa.array(ids), pa.array(at), before, suffix], names)

    @tidy
    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in run(batches):
            held.append(batch)
            if sum(b.num_rows for b in held) >= 10_000 or len(held) >= 2_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return both.mapInArrow(gathered, "apart boolean, _id long, at long, before binary, suffix binary")


def matrix(texts: list[bytes], width: int, backwards: bool = False) -> np.ndarray:
    """Texts as rows of ``width`` bytes, zeros after their last one."""
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    row = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(texts), width), np.uint8)
    out[row, np.repeat(size, size) - 1 - place if backwards else place] = flat
    return out


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """The order of rows of bytes (their number divisible by 8): multikey quicksort over words of eight bytes.

    Three-way partition around the median word: the equal part goes on with the
    next word, the other two with the same one; small parts are sorted at once.
    """
    words = rows.view(">u8").astype(np.uint64)
    order, todo = np.arange(len(rows)), [(0, len(rows), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == words.shape[1]:
            continue
        part = order[a:b]
        if b - a <= SMALL:
            order[a:b] = part[np.lexsort(words[part, depth:].T[::-1])]
            continue
        word = words[part, depth]
        pivot = np.partition(word, (b - a) // 2)[(b - a) // 2]
        less, more = word < pivot, word > pivot
        order[a:b] = np.concatenate([part[less], part[~less & ~more], part[more]])
        i, j = a + int(less.sum()), b - int(more.sum())
        todo += [(a, i, depth), (i, j, depth + 1), (j, b, depth)]
    return order


class Sorted:
    """Rows of bytes in order, and how many bytes each has in common with the one before."""

    def __init__(self, rows: np.ndarray):
        order = multikey_order(rows)
        ordered = rows[order]
        differ = ordered[1:] != ordered[:-1]
        self.common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        self.rank = np.empty(len(rows), np.int64)
        self.rank[order] = np.arange(len(rows))

    def classes(self, size: int) -> np.ndarray:
        """A number for each row; rows that share their first ``size`` bytes have the same."""
        return np.concatenate([[0], np.cumsum(self.common < size)])[self.rank]


def repeats_in_bucket(ids: np.ndarray, at: np.ndarray, before: list[bytes], suffix: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(_id, start, stop) of the passages that equal an earlier one among contexts.

    A passage that starts ``o`` bytes before its anchor equals another if o
    bytes before and length - o bytes from the anchor on are the same.
    """
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    before, suffix = [before[k] for k in order], [suffix[k] for k in order]
    most = length - gram
    forward, backward = Sorted(matrix(suffix, -(-length // 8) * 8)), Sorted(matrix(before, -(-max(most, 1) // 8) * 8, backwards=True))
    off = np.array([len(b) for b in before], np.int64)
    least = length - np.array([len(s) for s in suffix], np.int64)
    repeated = np.zeros((len(ids), most + 3), bool)
    for o in range(most + 1):
        rows = np.flatnonzero((least <= o) & (o <= off))
        if len(rows) > 1:
            key = forward.classes(length - o)[rows] * len(ids) + backward.classes(o)[rows]
            first = np.unique(key, return_index=True)[1]
            again = np.ones(len(rows), bool)
            again[first] = False
            repeated[rows[again], o + 1] = True
    edge = np.diff(repeated.astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    return ids[row], at[row] - high, at[row] - low + length


def repeats_by_bucket(held: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """(_id, a, b): repeats among contexts, start and stop, range-partitioned by their suffixes' leading bytes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
        if table is not None:
            ids, a, b = repeats_in_bucket(table.column("_id").to_numpy(), table.column("at").to_numpy(), table.column("before").to_pylist(), table.column("suffix").to_pylist(), length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, a, b)], ["_id", "a", "b"])

    buckets = held.select("_id", "at", "before", "suffix").repartitionByRange(parts, F.substring("suffix", 1, gram))
    return buckets.mapInArrow(run, "_id long, a long, b long")


def repeats_in_order(held: DataFrame, parts: int, length: int) -> DataFrame:
    """(_id, a, b): repeats among the passages of contexts, each a suffix of its own, sorted over all and compared with the one before."""

    @tidy
    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                before, text = (batch.column(c)[k].as_py() for c in ("before", "suffix"))
                n, context = len(before) + len(text) - length + 1, before + text
                start = batch.column("at")[k].as_py() - len(before)
                ids = np.full(n, batch.column("_id")[k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([context[i : i + length] for i in range(n)], pa.binary()), pa.array(ids), pa.array(start + np.arange(n))], keys)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, first = TaskContext.get().partitionId(), None, None
        names = ["part", "edge", "passage", "_id", "a"]
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("passage").to_pylist()
            same = np.array([x == y for x, y in zip(flat, [last, *flat], strict=False)])
            first, last = first or (flat[0], batch.column("_id")[0].as_py(), batch.column("a")[0].as_py()), flat[-1]
            hit = np.flatnonzero(same)
            n = len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.binary()), batch.column("_id").take(pa.array(hit)), batch.column("a").take(pa.array(hit))], names)
        if first is not None:
            rows = [(part, 1, *first), (part, 2, last, 0, 0)]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    keys = ["passage", "_id", "a"]
    order = held.select("_id", "at", "before", "suffix").mapInArrow(passages, "passage binary, _id long, a long")
    order = order.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    out = written(order.mapInArrow(run, "part int, edge int, passage binary, _id long, a long"), "order")
    lasts = out.where("edge = 2").select(F.col("part").alias("of"), F.col("passage").alias("last"))
    firsts = out.where("edge = 1").join(lasts, F.expr("passage = last and of < part"), "left_semi")
    return out.where("edge = 0").unionByName(firsts).select("_id", "a", (F.col("a") + length).alias("b"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, int]:
    """(_id, a, b): spans of docs(_id, t), start and stop, that together cover all repeats; and the number of partitions that suits the texts.

    ``_id`` must tell documents apart and order them.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0))).first()[0]
    parts = 1 + total // PART_BYTES
    found = written(marks(docs, parts, length, gram), "marks")
    held = written(contexts(docs, found, parts, length), "contexts")
    size = F.octet_length("before") + F.octet_length("suffix") - (length - 1)
    n, passages = held.agg(F.count(F.when(~F.col("apart"), 1)), F.coalesce(F.sum(F.when(F.col("apart"), size)), F.lit(0))).first()
    spans = found.where(f"kind = {REPEAT}").select("_id", "a", "b")
    spans = spans.unionByName(repeats_by_bucket(held.where("not apart"), 1 + n // BUCKET_ROWS, length, gram))
    if passages:
        spans = spans.unionByName(repeats_in_order(held.where("apart"), 1 + passages // BUCKET_PASSAGES, length))
    spans = written(spans, "spans")
    dropped(found, held)
    return spans, parts


def on_characters(text: bytes, start: int, stop: int) -> tuple[int, int]:
    """The part of a cut that takes whole UTF-8 characters."""
    while start < stop and text[start] & 0xC0 == 0x80:
        start += 1
    while stop > start and stop < len(text) and text[stop] & 0xC0 == 0x80:
        stop -= 1
    return start, stop


def cut_records(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, characters: bool = False) -> DataFrame:
    """``without_repeats`` with the input's columns together in one struct ``_record``, so that none has to give way."""
    docs = numbered(documents)
    spans, parts = repeats(docs.select("_id", F.col("_record.text").cast("binary").alias("t")), length, gram)
    each = spans.repartition(parts, "_id").groupBy("_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = docs.repartition(parts, "_id").join(each.hint("shuffle_hash"), "_id", "left").select("_record", "spans")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                kept, removed = [], []
                for t, held in zip(batch.column("_record").field("text").cast(pa.binary()), batch.column("spans"), strict=True):
                    t, cuts = t.as_py() or b"", []
                    if held.is_valid:
                        a, b, _ = merged(held.values.field("a").to_numpy(), held.values.field("b").to_numpy())
                        cuts = list(zip(a.tolist(), b.tolist(), strict=True))
                    if characters:
                        cuts = [(a, b) for a, b in (on_characters(t, *c) for c in cuts) if a < b]
                    removed.append([{"start": a, "stop": b} for a, b in cuts])
                    edges = [0, *(x for cut in cuts for x in cut), len(t)]
                    kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([batch.column("_record"), pa.array(kept, pa.binary()), pa.array(removed, kind)], ["_record", "kept", "removed"])

    schema = and_fields(joined.select("_record").schema, "kept binary, removed array<struct<start:bigint,stop:bigint>>")
    return joined.mapInArrow(run, schema)


def without_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, characters: bool = False) -> DataFrame:
    """``documents`` with ``kept`` (binary, what is left of the text) and ``removed`` (array<struct<start,stop>>, byte runs).

    Bytes are UTF-8; passages never cross documents and are judged on the
    input.  Null texts count as empty: nothing is removed.  Documents shorter
    than ``length`` bytes stay whole.  Where doc_ids repeat, rows are ordered
    by doc_id (null first), then text, and then arbitrarily, and each row is a
    document of its own.  ``characters`` leaves the bytes of characters that a
    cut would split.  An empty table gives an empty one.  Input columns named
    ``kept`` or ``removed`` give way to the new ones; all others are kept,
    whatever their names.
    """
    names = [named(c) for c in documents.columns if c not in ("kept", "removed")]
    return cut_records(documents.select(*names), length, gram, characters).select("_record.*", "kept", "removed")


def digests(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    out = without_repeats(documents.select("doc_id", "text"), length)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
