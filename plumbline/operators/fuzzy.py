"""Near duplicates among records that share a blocking key, all of them, whatever the size of a block.

Records of equal text and keys are one: the first stands for its copies.  The
pairs of small blocks come from a join.  Large blocks are dealt into tiles of
about 2,000 records; a task compares two tiles (or one with itself), so a block
may hold any share of the records.  ``functions.wordsets`` compares all pairs of two tiles as arrays.

A pair that shares several keys is compared at the least of them only.

Who only asks what is connected need not compare all pairs (``connections``): in a tile
a component grows until nothing outside is similar to what it holds.  Tiles of 500 records come
first, since what they connect (all blocks together) need not be compared again; larger blocks are dealt anew into
tiles of up to 20,000, and in blocks beyond that all that lies outside the largest component is compared with the whole block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .. import config
from ..functions.similarity import token_set_ratio
from ..functions.wordsets import WordSets
from ..shared import written

PAIRS, LINKS = "a long, b long, score double", "a long, b long"
#: Members up to which a block is joined, members of a tile whose pairs are all compared, of tiles that are searched for components first and then.
JOINED, TILE, FIRST, SEARCHED = 16, 2000, 500, 20_000


def grouped(df: DataFrame, *keys: str) -> GroupedData:
    """Groups whose work grows with the square of their rows: in as many partitions as cores can use, which Spark would join for their few bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys).groupBy(*keys)


def representatives(rows: DataFrame) -> DataFrame:
    """rows(row, text, keys) with one row, the first, for each text and set of keys; keys sorted, without repeats."""
    return rows.select("row", "text", F.array_sort(F.array_distinct("keys")).alias("keys")).groupBy("text", "keys").agg(F.min("row").alias("row"))


def copies(rows: DataFrame, first: DataFrame) -> DataFrame:
    """(a, b): each further row b of a text and keys, with the first."""
    own = rows.select("row", "text", F.array_sort(F.array_distinct("keys")).alias("keys")).where(F.size("keys") > 0)
    return own.join(first.withColumnRenamed("row", "a"), ["text", "keys"]).where("row <> a").select("a", F.col("row").alias("b"))


def block_sizes(rows: DataFrame) -> DataFrame:
    """(key, members) of each block: which of them, and how many records, a limit would leave out."""
    return rows.select("row", F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count("*").alias("members"))


def similar(left: list[str], right: list[str], threshold: float, within: bool) -> Iterator[tuple[int, int, float]]:
    """(i, j, score) of the pairs at or above the threshold; ``within`` takes each pair of one list once."""
    for i, j, score in compared(left, right, threshold, within):
        yield from zip(i.tolist(), j.tolist(), score.tolist(), strict=True)


def compared(left: list[str], right: list[str], threshold: float, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``similar`` as arrays, some pairs at a time."""
    n = len(left)
    sets = WordSets(left if within else [*left, *right])
    own = np.arange(n)
    for i, j, score in sets.compare(own, own if within else np.arange(n, n + len(right)), threshold, within):
        yield (np.minimum(i, j), np.maximum(i, j), score) if within else (i, j - n, score)


class Blocks:
    """The records of each key of rows(row, text, keys): ``keyed``, the ``sizes`` of blocks of two and more, and the pairs of small ones."""

    def __init__(self, rows: DataFrame, threshold: float, max_block: int | None):
        self.keyed = written(rows.select("row", "text", "keys", F.explode("keys").alias("key")), "keyed")
        sizes = self.keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        self.sizes = written(sizes.where(F.col("members") <= max_block) if max_block else sizes, "sizes")
        members = self.keyed.join(self.sizes.where(f"members <= {JOINED}").select("key"), "key")
        other = members.select("key", F.col("row").alias("b"), F.col("text").alias("tb"), F.col("keys").alias("kb"))
        few = members.join(other, "key").where("row < b").where(F.array_min(F.array_intersect("keys", "kb")) == F.col("key"))
        self.few = few.withColumn("score", token_set_ratio("text", "tb")).where(F.col("score") >= threshold).select(F.col("row").alias("a"), "b", "score")

    def large(self, tile: int, above: int = 0) -> DataFrame | None:
        """(key, tiles) of the others with more than ``above`` members, None without any."""
        large = self.sizes.where(f"members > {max(JOINED, above)}").select("key", F.ceil(F.col("members") / tile).cast("int").alias("tiles"))
        return large if large.limit(1).count() else None


def pairs(rows: DataFrame, threshold: float = config.FUZZY_THRESHOLD, max_block: int | None = None) -> DataFrame:
    """(a, b, score), a < b, of all rows(row, text, keys) that share a key and are similar.

    Texts and keys should differ between rows (see ``representatives``).  A null or empty list of keys pairs with
    nothing.  With ``max_block`` larger blocks are left out, as the rule's first form had it.
    """
    blocks = Blocks(rows, threshold, max_block)
    if (big := blocks.large(TILE)) is None:
        return blocks.few
    # a pair that also shares a lower key is compared there
    lower = F.filter("keys", lambda k: k < F.col("key"))
    dealt = blocks.keyed.join(big, "key").withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int")).withColumn("lower", lower)
    dealt = dealt.select("key", "row", "text", "lower", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("key", "row", "text", "lower", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))

    def compare(tiles: pa.Table) -> pa.Table:
        i, j = (tiles.column(n)[0].as_py() for n in "ij")
        tile, row, lower = tiles.column("tile").to_numpy(), tiles.column("row").to_numpy(), numbered(tiles.column("lower").to_pylist())
        texts = tiles.column("text").to_pylist()
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        a, b, scores = [row[:0]], [row[:0]], [np.zeros(0)]
        for x, y, score in compared([texts[k] for k in left], [texts[k] for k in right], threshold, i == j):
            x, y = left[x], right[y]
            here = ~(lower[x][:, :, None] == lower[y][:, None, :]).any(axis=(1, 2))
            a.append(np.minimum(row[x], row[y])[here])
            b.append(np.maximum(row[x], row[y])[here])
            scores.append(score[here])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "score": np.concatenate(scores)})

    many = grouped(dealt, "key", "i", "j").applyInArrow(compare, PAIRS)
    return blocks.few.unionByName(many)


def numbered(lists: list[list[str]]) -> np.ndarray:
    """Lists of keys as rows of numbers, filled up with a number below zero that no other row has."""
    ids: dict[str, int] = {}
    out = np.repeat(-1 - np.arange(len(lists))[:, None], max(map(len, lists), default=0), axis=1)
    for k, keys in enumerate(lists):
        out[k, : len(keys)] = [ids.setdefault(key, len(ids)) for key in keys]
    return out


def search(tile: pa.Table, threshold: float) -> pa.Table:
    """Links that connect what similar pairs of a tile's records connect, beyond what their labels say."""
    row = tile.column("row").to_numpy()
    found = np.array(WordSets(tile.column("text").to_pylist()).links(tile.column("label").to_numpy(), threshold), np.int64).reshape(-1, 2)
    return as_links(row, found)


def as_links(row: np.ndarray, found: np.ndarray) -> pa.Table:
    return pa.table({"a": row[found].min(axis=1), "b": row[found].max(axis=1)} if len(found) else {"a": row[:0], "b": row[:0]})


def connections(rows: DataFrame, threshold: float = config.FUZZY_THRESHOLD, max_block: int | None = None) -> DataFrame:
    """(a, b) of similar pairs, some of ``pairs``, with the same components as all of them."""
    from .records import components

    blocks = Blocks(rows, threshold, max_block)
    found, members = blocks.few.select("a", "b"), blocks.keyed.select("key", "row", "text", F.col("row").alias("label"))

    def labelled() -> DataFrame:
        known = components(found).select(F.col("node").alias("row"), "component")
        return members.drop("label").join(known, "row", "left").select("key", "row", "text", F.coalesce("component", "row").alias("label"))

    # blocks of one tile are done with it
    for seed, (size, above) in enumerate(((FIRST, 0), (SEARCHED, FIRST))):
        if (big := blocks.large(size, above)) is None:
            return found
        members = labelled() if seed else members
        dealt = members.join(big, "key").select("key", "row", "text", "label", F.pmod(F.xxhash64("row", F.lit(seed)), F.col("tiles")).alias("tile"))
        found = written(found.unionByName(grouped(dealt, "key", "tile").applyInArrow(lambda t: search(t, threshold), LINKS)), "links")
    if (big := blocks.large(SEARCHED, SEARCHED)) is None:
        return found
    return found.unionByName(crossing(written(labelled().join(big, "key"), "labelled"), threshold))


def crossing(members: DataFrame, threshold: float) -> DataFrame:
    """Links between members(key, row, text, tiles, label) of a block that are in different components: all outside its largest one against the whole block."""
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"))
    sizes = sizes.where("outside > 0").select("key", "main", F.ceil(F.col("outside") / TILE).cast("int").alias("parts"))
    of = members.join(sizes, "key")
    part, tile = F.pmod(F.xxhash64("row", F.lit(2)), F.col("parts")).cast("int"), F.pmod(F.xxhash64("row", F.lit(3)), F.col("tiles")).cast("int")
    outside = of.where("label <> main").select("key", "row", "text", "label", F.lit(True).alias("outer"), part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    whole = of.select("key", "row", "text", "label", F.lit(False).alias("outer"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), tile.alias("tile"))

    def compare(both: pa.Table) -> pa.Table:
        outer, row = both.column("outer").to_numpy(), both.column("row").to_numpy()
        sets = WordSets(both.column("text").to_pylist())
        found = sets.joining(np.flatnonzero(outer), np.flatnonzero(~outer), np.unique(both.column("label").to_numpy(), return_inverse=True)[1], threshold)
        return as_links(row, np.array(found, np.int64).reshape(-1, 2))

    return grouped(outside.unionByName(whole), "key", "part", "tile").applyInArrow(compare, LINKS)


def links(rows: DataFrame, threshold: float = config.FUZZY_THRESHOLD, max_block: int | None = None) -> DataFrame:
    """(a, b) whose components are those of all similar pairs that share a block: connections of representatives, and copies."""
    first = written(representatives(rows), "representatives")
    return connections(first, threshold, max_block).unionByName(copies(rows, first))
