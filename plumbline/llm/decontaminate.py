"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations alone.

A mask looks at some of the words of a window and ignores the others, so a
substituted word at an ignored place does not hide a match.  Seeds of the
benchmark and of the documents join on their hashes; around each hit, document
and item are laid against each other and compared word by word.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import back_to_id, small_side, whole_id, written

#: Words of an overlap that are judged together (a shorter item: all of them).
WINDOW = 13
SIMILARITY = 0.8
#: Most words that a mask looks at.
WEIGHT = 5
#: Broadcast the benchmark's seeds up to this many bytes; beyond, both sides are shuffled.
SEED_LIMIT = 64 << 20


@lru_cache(64)
def masks_for(width: int, wrong: int) -> tuple[tuple[int, ...], ...]:
    """Masks one of which, somewhere in ``width`` words, looks at none of any ``wrong`` of them.

    One mask if one suffices, else those that each find most of what is left; of the greatest weight for which this works.
    """
    for weight in range(min(WEIGHT, width - wrong), 0, -1):
        made = []
        for mask in combinations(range(width), weight):
            if mask[0] == 0:
                shifts = range(width - mask[-1])
                made.append((mask, {c for c in combinations(range(width), wrong) if any(not {p + k for p in mask} & set(c) for k in shifts)}))
        left, out = set(combinations(range(width), wrong)), []
        while left:
            mask, found = max(made, key=lambda m: (len(m[1] & left), -m[0][-1]))
            if not found & left:
                break
            out.append(mask)
            left -= found
        if not left and (len(out) <= 3 or weight == 1):
            return tuple(out)
    raise ValueError("no word may be required to agree")


def wrong_words(width: int, similarity: float) -> int:
    """How many of ``width`` words may differ."""
    return next(k for k in range(width, -1, -1) if (width - k) / width >= similarity - 1e-12)


def word_hashes(text: str) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def seeds(df: DataFrame, words: str, pos: str, masks: list[tuple[int, ...]]) -> DataFrame:
    """(mask, seed, pos) for every place of every mask in an array of word hashes, with the other columns of ``df``.

    The array itself is left behind: kept in every row, it would be copied once for each of its words.
    """
    used = sorted({k for m in masks for k in m})
    rest = [c for c in df.columns if c != words]
    shifted = F.arrays_zip(*[F.slice(words, k + 1, F.size(words)).alias(f"w{k}") for k in used])
    at = df.select(*rest, F.posexplode(shifted).alias(pos, "_w"))
    by = {k: F.col(f"_w.w{k}") for k in used}
    made = F.array(*[F.when(by[m[-1]].isNotNull(), F.struct(F.lit(i).alias("mask"), F.xxhash64(*[by[k] for k in m]).alias("seed"))) for i, m in enumerate(masks)])
    return at.select(*rest, pos, F.explode(made).alias("_s")).where("_s is not null").select(*rest, pos, "_s.mask", "_s.seed")


def best_window(same: Column, width: Column) -> Column:
    """The most ones in any ``width`` neighbours of an array of 0 and 1."""
    starts = F.sequence(F.lit(1), F.size(same) - width + 1)
    return F.array_max(F.transform(starts, lambda i: F.aggregate(F.slice(same, i, width), F.lit(0), lambda a, x: a + x)))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, n_same, similarity, n_overlap) for each document and item that share a passage.

    They share one if, laid at some offset, ``window`` neighbouring words (all
    words of a shorter item) agree in a share of at least ``similarity``;
    masks are chosen for the items' lengths so that no such offset is missed.
    n_same is the most that agree, similarity its share, n_overlap the longest
    overlap of such an offset, in words.  Null and empty texts share nothing.
    Each row is judged for itself; the rows of one doc_id, or of one item_id,
    or those without one, report together.  Other columns are not read, and an
    empty table on either side gives an empty result.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes("text").alias("item")).where(F.size("item") > 0).distinct()
    items = written(items.withColumn("key", F.xxhash64("item_id", "item")), "items")
    total = items.agg(F.count("*"), F.coalesce(F.sum(F.size("item")), F.lit(0))).first()
    lengths = sorted(r[0] for r in items.select(F.least(F.size("item"), F.lit(window))).distinct().collect())
    if not lengths:
        return spark.createDataFrame([], "doc_id long, item_id long, n_same long, similarity double, n_overlap long")
    masks = sorted({m for w in lengths for m in masks_for(w, wrong_words(w, similarity))})
    keys = seeds(items.select("key", F.size("item").alias("n_item"), "item"), "item", "item_at", masks).distinct()
    keys = small_side(written(keys, "seeds"), 40, SEED_LIMIT)
    docs = documents.select(whole_id("doc_id").alias("_id"), F.xxhash64("text").alias("_of"), "text")
    hits = seeds(docs.select("_id", "_of", word_hashes("text").alias("words")), "words", "at", masks).join(keys, ["mask", "seed"])
    laid = hits.select("_id", "_of", "key", "n_item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    laid = written(laid.groupBy("_id", "_of").agg(F.collect_list(F.struct("key", "n_item", "shift")).alias("laid")), "hits")
    n = laid.agg(F.count("*"), F.coalesce(F.sum(F.size("laid")), F.lit(0))).first()
    near = docs.join(F.broadcast(laid) if 56 * n[0] + 24 * n[1] <= SEED_LIMIT else laid, ["_id", "_of"]).select("_id", word_hashes("text").alias("words"), "laid")

    def overlap(x: Column) -> Column:
        shift, skip = x["shift"], F.greatest(-x["shift"], F.lit(0))
        n = F.least(x["n_item"], F.size("words") - shift) - skip
        return F.struct(x["key"].alias("key"), skip.alias("skip"), n.alias("n"), F.slice("words", F.greatest(shift, F.lit(0)) + 1, F.greatest(n, F.lit(0))).alias("part"))

    near = near.select("_id", F.explode(F.transform("laid", overlap)).alias("o")).select("_id", "o.*")
    side = F.broadcast(items) if 56 * total[0] + 8 * total[1] <= SEED_LIMIT else items
    found = near.join(side, "key").withColumn("_w", F.least(F.lit(window), F.size("item"))).where(F.col("n") >= F.col("_w"))
    pair = F.zip_with("part", F.slice("item", F.col("skip") + 1, F.col("n")), lambda a, b: (a == b).cast("int"))
    found = found.select("_id", "item_id", F.col("n").alias("_n"), "_w", pair.alias("same"))
    found = found.where(F.aggregate("same", F.lit(0), lambda a, x: a + x) >= F.col("_w") * similarity)
    found = found.select(back_to_id("_id").alias("doc_id"), "item_id", "_n", "_w", best_window(F.col("same"), F.col("_w")).alias("n_same"))
    found = found.where(F.col("n_same") / F.col("_w") >= similarity - 1e-12)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("n_same").cast("long").alias("n_same"), F.max(F.col("n_same") / F.col("_w")).alias("similarity"), F.max("_n").cast("long").alias("n_overlap")
    )


#: The same in DuckDB SQL, without seeds: all equal words of document and item lay them against each other.
ORACLE = r"""
with d as (select row_number() over () row, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from documents),
b as (select row_number() over () item, * from (select distinct item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from benchmark)),
dp as (select row, unnest(w) word, unnest(range(len(w))) p from d),
bp as (select item, unnest(w) word, unnest(range(len(w))) p from b),
m as (select row, item, dp.p - bp.p shift, bp.p p from dp join bp using (word)),
g as (select row, item, shift from m join b using (item) group by row, item, shift, len(w) having count(*) / least(13, len(w))::double >= 0.8 - 1e-12),
lay as (select g.*, d.doc_id, b.item_id, greatest(-shift, 0) skip, least(len(b.w), len(d.w) - shift) - greatest(-shift, 0) n, least(13, len(b.w)) wd from g join d using (row) join b using (item)),
own as (select lay.*, p, least(p, skip + n - wd) s from lay join m using (row, item, shift) where n >= wd),
top as (select a.row, a.item, a.shift, a.doc_id, a.item_id, a.n, a.wd, a.s, count(*) same from (select distinct row, item, shift, doc_id, item_id, n, wd, s from own) a join own b on a.row = b.row and a.item = b.item and a.shift = b.shift and b.p >= a.s and b.p < a.s + a.wd group by all)
select doc_id, item_id, max(same)::bigint n_same, max(same / wd::double) similarity, max(n)::bigint n_overlap
from top where same / wd::double >= 0.8 - 1e-12 group by doc_id, item_id
"""
