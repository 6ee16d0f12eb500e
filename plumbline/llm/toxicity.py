"""Toxicity scores from two class-conditional Kneser-Ney models.

The models predict the next symbol (letters and breaks of the lower-cased
text, whole code points) from the ``ORDER - 1`` before it.  Each class has its
own counts of n-grams; where they are rare both back off to the same shared
lower orders, whose Kneser-Ney continuation counts are taken over both classes,
down to single symbols and a uniform share.  A text's evidence is the
difference of its length-normalised log-likelihoods under the two models: over
the whole text, and over its most toxic passages of some lengths.  A logistic
curve, none of whose weights is negative, turns it into a score.

Counts cover every labelled text and every n-gram, and so does the model: a
table from keys (64-bit hashes of n-grams and of contexts) to log ratios.  Up
to ``SENT_BYTES`` of it are sent to all tasks.  Beyond, batches of documents ask
for the distinct keys they hold, the requests join the model, and each batch
meets its answers again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import and_fields, named, pieces, slices, small_side, tidy, whole_id, written

ORDER = 5
#: The model is sent to all tasks up to so many bytes (12 a key).
SENT_BYTES = 48 << 20
#: Labelled texts of the fold left out of the counts that the logistic curve is fitted on, at most.
FIT_ROWS = 20_000
#: Text that a task counts at a time.
COUNT_BYTES = 1 << 20
#: Symbols in a passage, short and long.
PASSAGES = (12, 48)
FEATURES = ("whole", "short", "long")
#: Rows of a batch that asks for its keys, as a power of two.
BATCH_BITS = 12
#: Discount of the shared lower orders.
SHARED = 0.75

BREAK = re.compile(r"[\W\d_]+")
FACTORS = np.random.default_rng(11).integers(1, 1 << 63, ORDER, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
CONTEXT = np.uint64(0x9E3779B97F4A7C15)


def folded(text: str | None) -> str:
    """A text as the models see it: small letters, any other run one space, after ORDER - 1 spaces; empty without letters."""
    flat = BREAK.sub(" ", (text or "").lower()).strip()
    return " " * (ORDER - 1) + flat + " " if flat else ""


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def keys_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of a row of code points, and of their contexts (all symbols but the last)."""
    n = max(len(symbols) - ORDER + 1, 0)
    s = symbols.astype(np.uint64)
    context = np.full(n, CONTEXT)
    for k in range(ORDER - 1):
        context += s[k : k + n] * FACTORS[k]
    gram = context + s[ORDER - 1 : ORDER - 1 + n] * FACTORS[ORDER - 1] + CONTEXT
    return mixed(gram), mixed(context)


def laid_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts one after another, and where each ends."""
    flat = [folded(t) for t in texts]
    return np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), "<u4"), np.cumsum([len(t) for t in flat])


class Table:
    """A model as a sorted array of keys: exact, whatever its size."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray):
        order = np.argsort(keys.view(np.uint64))
        self.keys, self.ratios = keys.view(np.uint64)[order], ratios[order].astype(np.float32)
        bits = max(len(keys), 1).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.append(np.searchsorted(self.keys, edges), len(keys)).astype(np.int32)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log ratios, 0 where a key is unknown, and whether it is known."""
        out, known = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        slot = (keys >> self.shift).astype(np.int64)
        at, stop, todo = self.first[slot], self.first[slot + 1], np.arange(len(keys))
        while True:
            live = at < stop
            at, stop, todo = at[live], stop[live], todo[live]
            if not len(todo):
                return out, known
            hit = self.keys[at] == keys[todo]
            out[todo[hit]], known[todo[hit]] = self.ratios[at[hit]], True
            at, stop, todo = at[~hit] + 1, stop[~hit], todo[~hit]


def evidence(texts: list[str | None], model: Table) -> np.ndarray:
    """For each text the mean log ratio of its symbols, and those of its most toxic passages; 0 without letters."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in pieces(texts):
        symbols, ends = laid_out(texts[a:b])
        gram, context = keys_of(symbols)
        ratio, known = model.get(gram)
        ratio[~known] = model.get(context[~known])[0]
        run = np.concatenate([[0.0], np.cumsum(ratio, dtype=np.float64)])
        start = 0
        for k, end in enumerate(ends.tolist(), a):
            if (n := end - start - ORDER + 1) > 0:
                own = run[start : start + n + 1]
                out[k, 0] = (own[-1] - own[0]) / n
                for j, size in enumerate(PASSAGES, 1):
                    w = min(size, n)
                    out[k, j] = (own[w:] - own[:-w]).max() / w
            start = end
    return out


def count_grams(labelled: DataFrame) -> DataFrame:
    """Counts (gram string, toxic, ordinary) over all texts of (text, toxic)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) == 1
            texts = batch.column("text").to_pylist()
            for a, b in pieces(texts, COUNT_BYTES):
                symbols, ends = laid_out(texts[a:b])
                key = keys_of(symbols)[0]
                owner = np.searchsorted(ends, np.arange(len(key)), side="right")
                own = np.flatnonzero(np.arange(len(key)) + ORDER <= ends[owner]) if len(key) else np.zeros(0, np.int64)
                _, first, at = np.unique(key[own], return_index=True, return_inverse=True)
                which = toxic[a:b][owner[own]] if len(own) else np.zeros(0, bool)
                t, o = (np.bincount(at[w], minlength=len(first)).astype(np.int64) for w in (which, ~which))
                grams = symbols[own[first][:, None] + np.arange(ORDER)].astype("<u4").view(f"<U{ORDER}").ravel() if len(first) else []
                yield pa.RecordBatch.from_arrays([pa.array([str(g) + " " * (ORDER - len(g)) for g in grams], pa.string()), pa.array(t), pa.array(o)], ["gram", "toxic", "ordinary"])

    local = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "gram string, toxic long, ordinary long")
    return local.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def discount(n1: float, n2: float) -> float:
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def shared_orders(grams: DataFrame) -> DataFrame:
    """(tail, p): the shared probability of the last symbol of each tail (a gram without its first symbol) after those before it.

    Kneser-Ney continuation counts order by order: how many different symbols
    stand before a tail; the order below takes the tails' own tails, down to
    single symbols, which share with all symbols alike.
    """
    levels = []
    for size in range(ORDER - 1, 0, -1):
        of = grams if not levels else levels[-1]
        level = of.groupBy(F.substring(of.columns[0], 2, size).alias("tail")).agg(F.count("*").cast("double").alias("c"))
        levels.append(written(level, "tails"))
    alike = 1.0 / (levels[-1].count() + 1)
    below = None
    for size, level in enumerate(reversed(levels), 1):
        context = F.substring("tail", 1, size - 1)
        sums = level.groupBy(context.alias("h")).agg(F.sum("c").alias("c_h"), F.count("*").alias("types"))
        joined = level.withColumn("h", context).join(sums, "h")
        if below is None:
            low = F.lit(alike)
        else:
            joined = joined.withColumn("rest", F.substring("tail", 2, size - 1)).join(below.withColumnsRenamed({"tail": "rest", "p": "low"}), "rest")
            low = F.col("low")
        p = F.greatest(F.col("c") - SHARED, F.lit(0.0)) / F.col("c_h") + SHARED * F.col("types") / F.col("c_h") * low
        below = written(joined.select("tail", p.alias("p")), "shared")
    return below


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, ratio, toxic, ordinary) for counted n-grams and (context, ratio) for others in a counted context.

    ratio is the log of the toxic model's probability over the ordinary one's;
    toxic and ordinary are the two probabilities.
    """
    g = counts.withColumns({"h": F.substring("gram", 1, ORDER - 1), "tail": F.substring("gram", 2, ORDER - 1)})
    n = counts.agg(*[F.count(F.when(F.col(c) == k, 1)).alias(f"{c}{k}") for c in ("toxic", "ordinary") for k in (1, 2)]).first()
    d = {"toxic": discount(n.toxic1, n.toxic2), "ordinary": discount(n.ordinary1, n.ordinary2)}
    per_h = g.groupBy("h").agg(*[F.sum(c).alias(f"{c}_h") for c in d], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_types") for c in d])

    def left(c: str) -> Column:
        return F.when(F.col(f"{c}_h") > 0, d[c] * F.col(f"{c}_types") / F.col(f"{c}_h")).otherwise(F.lit(1.0))

    def prob(c: str) -> Column:
        return F.when(F.col(f"{c}_h") > 0, F.greatest(F.col(c) - d[c], F.lit(0.0)) / F.col(f"{c}_h")).otherwise(F.lit(0.0)) + left(c) * F.col("p")

    seen = g.join(shared_orders(counts), "tail").join(per_h, "h").select("gram", *[prob(c).alias(c) for c in d])
    unseen = per_h.select(F.col("h").alias("context"), F.log(left("toxic") / left("ordinary")).alias("ratio"))
    return seen.select("gram", F.log(F.col("toxic") / F.col("ordinary")).alias("ratio"), "toxic", "ordinary"), unseen


def keyed(seen: DataFrame, unseen: DataFrame) -> DataFrame:
    """(key, ratio): both tables by the keys under which ``evidence`` looks."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("gram").to_pylist()
            symbols = np.frombuffer("".join(g.ljust(ORDER) for g in grams).encode("utf-32-le", "surrogatepass"), "<u4")
            gram, context = (k[::ORDER] for k in keys_of(symbols))
            whole = batch.column("whole").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(whole, gram, context).view(np.int64)), batch.column("ratio")], ["key", "ratio"])

    both = seen.select("gram", "ratio", F.lit(True).alias("whole")).unionByName(unseen.select(F.col("context").alias("gram"), "ratio", F.lit(False).alias("whole")))
    return both.withColumn("ratio", F.col("ratio").cast("float")).mapInArrow(run, "key long, ratio float")


@dataclass
class Model:
    """A written table (key, ratio), how many rows it has, and the curve: a weight for each feature, then the constant."""

    table: DataFrame
    rows: int
    weights: np.ndarray = field(default_factory=lambda: np.array([1.0, 2.0, 4.0, -1.0]))

    def __post_init__(self) -> None:
        self.sent = None

    def small(self) -> bool:
        return 12 * self.rows <= SENT_BYTES

    def broadcast(self):
        if self.sent is None:
            got = self.table.toArrow()
            self.sent = self.table.sparkSession.sparkContext.broadcast(Table(got.column("key").to_numpy(), got.column("ratio").to_numpy()))
        return self.sent


def text_of(batch: pa.RecordBatch | pa.Table) -> list[str | None]:
    found = batch.column("text") if "text" in batch.schema.names else pc.struct_field(batch.column("_record"), "text")
    return found.to_pylist()


def with_evidence(rows: DataFrame, model: Model) -> DataFrame:
    """(_record, whole, short, long) for rows(_record, text), or rows(_record) with the text in the record."""
    schema = and_fields(rows.select("_record").schema, ", ".join(f"{c} double" for c in FEATURES))

    def judged(batch: pa.RecordBatch | pa.Table, table: Table) -> list:
        return [batch.column("_record"), *map(pa.array, evidence(text_of(batch), table).T.copy())]

    names = ["_record", *FEATURES]
    if model.small():
        sent = model.broadcast()

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield pa.RecordBatch.from_arrays(judged(batch, sent.value), names)

        return rows.mapInArrow(run, schema)

    @tidy
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, of = batch.column("text").to_pylist(), batch.column("_batch").to_numpy()
            for one in np.unique(of).tolist():
                own = [t for t, x in zip(texts, of == one, strict=True) if x]
                held = np.zeros(0, np.uint64)
                for a, b in pieces(own):
                    held = np.union1d(held, np.unique(np.concatenate(keys_of(laid_out(own[a:b])[0]))))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), one)), pa.array(held.view(np.int64))], ["_batch", "key"])

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        table = Table(right.column("key").to_numpy(), right.column("ratio").to_numpy())
        return pa.Table.from_arrays(judged(left, table), names)

    batched = rows.withColumn("_batch", F.shiftright(F.monotonically_increasing_id(), BATCH_BITS))
    text = F.col("text") if "text" in rows.columns else F.col("_record.text")
    requests = batched.select(text.alias("text"), "_batch").mapInArrow(asked, "_batch long, key long")
    answers = requests.join(model.table, "key")
    return batched.groupBy("_batch").cogroup(answers.groupBy("_batch")).applyInArrow(answered, schema)


def chance(weights: np.ndarray) -> Column:
    """The logistic curve over the features."""
    z = F.lit(float(weights[-1]))
    for c, w in zip(FEATURES, weights, strict=False):
        z = z + F.col(c) * float(w)
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Newton's method for a ridge logistic regression; weights with the constant last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_positive(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of which none but the constant is negative: features that would get one are left out, the most negative first."""
    used = list(range(x.shape[1]))
    while True:
        w = fit_logistic(x[:, used], y)
        if not used or w[:-1].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[*used, -1]] = w
            return out
        used.pop(int(w[:-1].argmin()))


def train(documents: DataFrame, labels: DataFrame, held_out: int | None = 0) -> Model | None:
    """Train on labelled documents outside the fold ``held_out`` of crc32(doc_id) mod 5.

    Fold 1 fits the curve (``FIT_ROWS`` rows at most, those of the smallest
    hash); the others give the counts, all of them.  None if either class has
    no labelled text.  Several labels of a document: the toxic one counts.
    Documents that share an id share its label; null ids have none.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("toxic"))
    fold = F.crc32(F.col("_id").cast("string")) % 5
    marked = written(marked.withColumn("fold", fold.cast("int")), "labels")
    if held_out is not None:
        marked = marked.where(F.col("fold") != held_out)
    docs = documents.select(whole_id("doc_id").alias("_id"), "text").join(small_side(marked, 24), "_id")
    counts = written(count_grams(docs.where("fold <> 1")), "grams")
    total = counts.agg(F.sum("toxic").alias("t"), F.sum("ordinary").alias("o")).first()
    if not total.t or not total.o:
        return None
    table = written(keyed(*kneser_ney(counts)), "model")
    model = Model(table, table.count())
    few = docs.where("fold = 1").select(F.struct("_id", F.col("toxic").cast("int").alias("toxic")).alias("_record"), "text")
    rows = with_evidence(few, model).select("_record.*", *FEATURES).orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS).toPandas()
    if rows.toxic.nunique() == 2:
        model.weights = fit_positive(rows[list(FEATURES)].to_numpy(), (rows.toxic == 1).to_numpy(float))
    return model


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, predicted) for every row.

    score is 0 to 1, predicted is 1 from 0.5 on.  Null texts and texts without
    letters get the curve's value for no evidence; without a model every score
    is 0.  Repeated rows get equal scores; other columns are not read.
    """
    rows = documents.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("_record"), "text")
    if model is None:
        return rows.select("_record.doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    got = with_evidence(rows, model).select("_record.doc_id", chance(model.weights).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(documents: DataFrame, model: Model | None) -> DataFrame:
    """``documents`` without the rows that the model predicts to be toxic; all columns stay, whatever their names."""
    if model is None:
        return documents
    rows = documents.select(F.struct(*[named(c) for c in documents.columns]).alias("_record"))
    return with_evidence(rows, model).where(chance(model.weights) < 0.5).select("_record.*")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels outside fold 0 and score every document: doc_id, held_out, score, predicted."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    return score(documents, train(documents, labels)).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")
