"""Near copies by SimHash, held against the Jaccard similarity of word shingles, with an exact prefix-filter join for the rest.

SimHash fingerprints of five-word shingles propose pairs by multi-index hashing;
those whose sets are similar enough are links.  Fingerprints miss similar pairs,
so a join finds the ones between documents that these links leave apart: two sets of at least ``SIMILARITY`` share one of their first n - ceil(0.8 n) + 1
shingles in any common order, so documents that share such a shingle are all
the candidates there are.  Shingles met often come last in that order, and of
shingles that the same documents share one is used, which only saves work.  Candidates are compared whole, shingle by shingle, unless
1,024 parities of their shingles differ in more places than two similar sets can.

Only components matter, so of the documents that share a shingle each is first
compared with a few; then those of different components with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, dropped, slices, small_side, tidy, written

SHINGLE = 5
#: Least similarity, as a fraction.
SIMILARITY = (4, 5)
SEED = 42
#: Shingles that a task counts together, how often one must be met there to be told, and how many are told apart: these decide the order alone.
COUNTED, OFTEN, FREQUENT = 1 << 20, 2, 1 << 18
#: Classes of shingles whose parities travel with each document, 64 to a column.
FEW = 1024
ODD = [f"s{k}" for k in range(FEW // 64)]
#: Documents of a group, at most, that all others of it are compared with first.
LEADS = 8
#: Classes of shingles whose parities pairs are compared by before their sets are.
CLASSES = 4096


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's lower-cased word shingles (a shorter text: all its words), sorted; none without words."""
    words = (text or b"").decode("utf-8", "replace").lower().encode().split()
    if not words:
        return np.zeros(0, np.int64)
    k, one = min(size, len(words)), xxhash.xxh64_intdigest
    flat, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: len(words) - k]]).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    return np.unique(np.array([one(flat[s:e], SEED) for s, e in zip(starts, stops, strict=True)], np.uint64).view(np.int64))


def same_words(documents: DataFrame) -> DataFrame:
    """(_id, k1, k2) of documents(_id, t): equal keys are equal words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [xxhash.xxh3_128_digest(b" ".join((t.as_py() or b"").decode("utf-8", "replace").lower().encode().split())) for t in batch.column("t")]
            key = np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy())], ["_id", "k1", "k2"])

    return documents.mapInArrow(run, "_id long, k1 long, k2 long")


def frequent(documents: DataFrame) -> np.ndarray:
    """Shingles that tasks meet often, rarest first; missing ones cost time, not results."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def told() -> pa.RecordBatch:
            keys, count = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys[count >= OFTEN]), pa.array(count[count >= OFTEN])], ["token", "n"])

        for batch in batches:
            for t in batch.column("t"):
                held.append(shingles(t.as_py()))
                n += len(held[-1])
                if n >= COUNTED:
                    yield told()
                    held, n = [], 0
        yield told()

    rows = documents.select("t").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return rows.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow().column("token").to_numpy()[::-1].copy()


def prefixes(documents: DataFrame, often: np.ndarray) -> DataFrame:
    """(_id, n, s0 and on, tokens): of each of documents(_id, t) with words how many shingles it has, for each of FEW classes of them whether their number is odd, and its first shingles."""
    rank = np.argsort(often)
    sent = documents.sparkSession.sparkContext.broadcast((often[rank], rank.astype(np.int32)))
    part, whole = SIMILARITY

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                cut, ids, sizes, odd, found = batch.slice(at, 1000), [], [], [], []
                for i, t in zip(cut.column("_id").to_pylist(), cut.column("t"), strict=True):
                    own = shingles(t.as_py())
                    if not (n := len(own)):
                        continue
                    odd.append(np.packbits(np.bincount(own & (FEW - 1), minlength=FEW) & 1))
                    if len(known):
                        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        own = own[np.argsort(np.where(known[place] == own, rank[place], -1), kind="stable")]
                    found.append(own[: n + (-part * n // whole) + 1])
                    ids.append(i)
                    sizes.append(n)
                words = np.array(odd, np.uint8).reshape(-1, FEW // 8).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(words[:, k].copy()) for k in range(len(ODD))), pa.array(found, pa.list_(pa.int64()))], ["_id", "n", *ODD, "tokens"])

    return documents.mapInArrow(run, f"_id long, n long, {', '.join(f'{c} long' for c in ODD)}, tokens array<long>")


def each_set(documents: DataFrame, column: str, made: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(_id, column): what is made of the shingles of each of documents(_id, t)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([made(shingles(t.as_py())) for t in batch.column("t")], pa.list_(pa.int64()))], ["_id", column])

    return documents.mapInArrow(run, f"_id long, {column} array<long>")


def parities(own: np.ndarray) -> np.ndarray:
    """For each of ``CLASSES`` classes of shingles whether their number is odd, as bits."""
    return np.packbits(np.bincount(own & (CLASSES - 1), minlength=CLASSES) & 1).view(np.int64)


def both_sides(pairs: DataFrame, held: DataFrame, column: str) -> DataFrame:
    """pairs(src, dst) with what held(_id, column) has of either, as a and b."""
    one, other = (held.select(F.col("_id").alias(side), F.col(column).alias(name)) for side, name in (("src", "a"), ("dst", "b")))
    return pairs.join(one, "src").join(other, "dst")


def those_in(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    ids = pairs.select(F.col("src").alias("_id")).unionByName(pairs.select(F.col("dst").alias("_id"))).distinct()
    return documents.join(small_side(written(ids, "ids"), 16), "_id", "left_semi")


def alike(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs(src, dst, n, m), written, of documents(_id, t) whose sets of shingles are similar enough.

    Sets travel only for pairs whose parities leave it open: each shingle in one set alone changes one of them.
    """
    part, whole = SIMILARITY
    held = written(each_set(those_in(documents, pairs), "odd", parities), "parities")
    apart = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    open_ = both_sides(pairs, held, "odd").where((whole + part) * apart <= (whole - part) * (F.col("n") + F.col("m"))).select("src", "dst")
    open_ = written(open_, "open")
    own = written(each_set(those_in(documents, open_), "own", lambda x: x), "sets")
    both = both_sides(open_, own, "own").withColumn("_n", F.size(F.array_intersect("a", "b")))
    found = written(both.where(F.col("_n") * whole >= (F.size("a") + F.size("b") - F.col("_n")) * part).select("src", "dst"), "links")
    dropped(held, own)
    return found


def by_fingerprints(documents: DataFrame, sizes: DataFrame) -> DataFrame:
    """(src, dst): the similar pairs among those that SimHash proposes, of documents(_id, t) with sizes(_id, n).

    Of equal fingerprints each document meets the first, of fingerprints within ``simhash.MAX_BITS`` bits the first ones meet.
    """
    each = written(simhash.fingerprints(documents.select(F.col("_id").alias("doc_id"), F.col("t").alias("text")), SHINGLE), "fingerprints")
    distinct = written(each.groupBy("fp").agg(F.min("_id").alias("first"), F.count("*").alias("k")), "distinct")
    equal = each.join(small_side(written(distinct.where("k > 1").select("fp", "first"), "equal"), 32), "fp").where("_id <> first").select(F.col("first").alias("src"), F.col("_id").alias("dst"))
    near = written(simhash.links(distinct.select("fp")), "near")
    of = {side: distinct.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_id")) for side in ("src", "dst")}
    near = near.join(of["src"], "src").join(of["dst"], "dst").select(F.least("src_id", "dst_id").alias("src"), F.greatest("src_id", "dst_id").alias("dst"))
    pairs = written(equal.unionByName(near), "proposed")
    sized = pairs.join(sizes.select(F.col("_id").alias("src"), "n"), "src").join(sizes.select(F.col("_id").alias("dst"), F.col("n").alias("m")), "dst")
    return alike(written(sized.select("src", "dst", "n", "m"), "pairs"), documents)


def once_a_group(members: DataFrame) -> DataFrame:
    """members(token, _id, ...) of one token for each set of documents that share tokens."""
    told = members.groupBy("token").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("_id")).alias("x"), F.bit_xor(F.xxhash64("_id", F.lit(SEED))).alias("y"), F.min("_id").alias("lo"))
    kept = told.groupBy("k", "x", "y", "lo").agg(F.min("token").alias("token")).select("token")
    return members.join(small_side(written(kept, "kept"), 16), "token", "left_semi")


def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with ``c``, their component over links, and of each token only those in which components differ."""
    named = written(components(links), "named")
    members = members.join(small_side(named, 32), members._id == named.node, "left").select("token", "_id", "n", *ODD, F.coalesce("component", "_id").alias("c"))
    members = written(members, "members")
    mixed = written(members.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token"), "mixed")
    return written(members.join(small_side(mixed, 16), "token"), "members")


def linked(documents: DataFrame) -> DataFrame:
    """(src, dst): links of documents(_id, t) whose components are those of all similar pairs.  ``_id`` must be unique."""
    part, whole = SIMILARITY
    first = written(prefixes(documents, frequent(documents)), "prefixes")
    each = first.select(F.explode("tokens").alias("token"), "_id")
    shared = written(each.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"), "shared")
    members = once_a_group(written(each.join(small_side(shared, 16), "token"), "shared"))
    guessed = by_fingerprints(documents, first.select("_id", "n"))
    members = labelled(members.join(first.drop("tokens"), "_id"), guessed)
    apart = " + ".join(f"bit_count({c} ^ o{c})" for c in ODD)
    near = f"{whole} * least(n, m) >= {part} * greatest(n, m) and {whole + part} * ({apart}) <= {whole - part} * (n + m)"
    other = {"_id": "o", "n": "m", "c": "d"} | {c: f"o{c}" for c in ODD}
    mixed = F.xxhash64("_id")  # the same documents lead in all groups that they are in
    lead = members.groupBy("token", F.pmod(mixed, F.lit(LEADS))).agg(F.min(F.struct(mixed.alias("h"), *other)).alias("l")).select("token", *[F.col(f"l.{c}").alias(o) for c, o in other.items()])
    pairs = members.join(small_side(written(lead, "leads"), 40 + 8 * len(ODD)), "token").where(f"c <> d and {near}")
    links = guessed.unionByName(alike(written(pairs.select(F.least("_id", "o").alias("src"), F.greatest("_id", "o").alias("dst"), "n", "m").dropDuplicates(["src", "dst"]), "pairs"), documents))
    members = labelled(members.drop("c"), links)
    main = members.groupBy("token", "c").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "c")).alias("x")).select("token", F.col("x.c").alias("main"))
    known = written(members.join(small_side(written(main, "main"), 32), "token"), "known")
    rest = known.where("c <> main").select("token", *[F.col(c).alias(o) for c, o in other.items()])
    pairs = known.join(rest, "token").where(f"c <> d and (c = main or _id < o) and {near}")
    pairs = written(pairs.select(F.least("_id", "o").alias("src"), F.greatest("_id", "o").alias("dst"), "n", "m").dropDuplicates(["src", "dst"]), "pairs")
    return links.unionByName(alike(pairs, documents))


def near_copies(documents: DataFrame) -> DataFrame:
    """(_id, component): the rows of documents(_id, text) that are near copies, or copies, of one with a smaller ``_id``.

    component is the smallest ``_id`` reachable over pairs of similarity 0.8 or
    more.  Texts without words (null, empty) are copies of each other.
    """
    docs = documents.select("_id", F.col("text").cast("binary").alias("t"))
    each = written(same_words(docs), "words")
    firsts = written(each.groupBy("k1", "k2").agg(F.min("_id").alias("first"), F.count("*").alias("k")), "firsts")
    again = written(each.join(small_side(written(firsts.where("k > 1"), "copied"), 40), ["k1", "k2"]).where("_id <> first").select("_id", "first"), "again")
    links = linked(docs.join(small_side(written(again.select("_id"), "ids"), 16), "_id", "left_anti"))
    named = small_side(written(components(links), "named"), 32)
    copies = again.join(named, again["first"] == named["node"], "left").select("_id", F.coalesce("component", "first").alias("component"))
    return copies.unionByName(named.where("node <> component").select(F.col("node").alias("_id"), "component"))
