"""Conversation structure repair: the cheapest edits, by a Viterbi search whose survivors coalesce.

A repaired conversation's role initials read ``(s?(ua)+)?``.  Each row is kept,
given the role that is due, or deleted, and empty turns may be inserted; four
states (nothing yet, after system, after user, after assistant) suffice, and the
state and an edit's initial determine the next state.  ``Survivors`` keeps one
best path for each state in a tree of back pointers with reference counts: nodes
that no survivor needs are freed at once, and edits are given out as soon as all
survivors descend from one node, so that only what is still open is held.

Equal costs are settled by the whole texts of the tied open paths.  Every row
ends in one of K, R and D, so no path is the beginning of another, and paths of
equal text are one path; therefore the order of two extended paths is that of
the paths they extend, and where these are one path, that of the new edits.
The survivors' order is carried along that way: comparing a tie takes one
step, however long the open texts are.

A conversation may hold any share of the rows.  Rows are dealt out by ranges of
(conversation, turn) into blocks.  Costs and orders from each state to each state
of a block's share of a conversation (16 numbers) are combined over the blocks,
which gives each block the state it starts from and the costs beyond its end;
then all blocks are repaired side by side.  First sights of a message are a
pre-aggregated minimum of places, not a window.  Only the digest of the
repaired text has to pass one task for a conversation (SHA-256 is sequential): it
streams there in parts of at most a megabyte that no batch gathers by number.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import small_side, written

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or re-roled turn: user and assistant take turns.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What is still to be inserted at the end.
ENDING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
FAR = 1 << 60
#: (state, other): what all rows to come cost from the state at most beyond what they cost from the other.  A state can insert
#: its way to another; after assistant and at the start the same turns may follow, but for a system turn (deleted for 2).
AT_MOST = {
    (START, SYSTEM): 0, (START, USER): INSERT, (START, ASSISTANT): 0,
    (SYSTEM, START): 2 * INSERT, (SYSTEM, USER): INSERT, (SYSTEM, ASSISTANT): 2 * INSERT,
    (USER, START): INSERT + DELETE, (USER, SYSTEM): INSERT, (USER, ASSISTANT): INSERT,
    (ASSISTANT, START): DELETE, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): INSERT,
}
SPACE = " \t\n\x0b\x0c\r"
BLOCK_BYTES, PART_BYTES = 16 << 20, 1 << 20

Options = dict[tuple[int, int], tuple[int, str]]


def kept_as(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role, or None where it may not stand here."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial == ("a" if state == USER else "u") else None


def options(initial: str, must_go: bool, truncated: bool) -> Options:
    """(state, next state) -> the cheapest and then least edits for one row, insertions before it included."""
    found: Options = {}
    for first in range(4):
        state = first
        for inserts in range(3):
            steps = [(state, DELETE, "D")]
            if not must_go:
                extra = TRUNCATED if truncated else 0
                steps.append((NEXT[state], REROLE + extra, "R"))
                if (after := kept_as(state, initial)) is not None:
                    steps.append((after, extra, "K"))
            for after, cost, letter in steps:
                new = (inserts * INSERT + cost, "I" * inserts + letter)
                found[first, after] = min(found.get((first, after), new), new)
            state = NEXT[state]
    return found


#: By role initial (s, u, a, other), whether the row must go, and whether it is truncated.
OPTIONS = {(i, g, t): options(i, g, t) for i in "sua-" for g in (False, True) for t in (False, True)}


def kind_of(initial: str, must_go: bool, truncated: bool) -> tuple[str, bool, bool]:
    return (initial if initial and initial in "sua" else "-", must_go, truncated and not must_go)


def step(costs: list[int], ranks: list[int], kind: tuple[str, bool, bool]) -> list[tuple[int, int, str] | None]:
    """For each state (cost, state before, edits) of the cheapest path into it, ties by the least whole path."""
    best: list[tuple[int, int, str, int] | None] = [None] * 4
    for (q, after), (cost, word) in OPTIONS[kind].items():
        if costs[q] >= FAR:
            continue
        new = (costs[q] + cost, ranks[q], word, q)
        if best[after] is None or new < best[after]:
            best[after] = new
    return [b and (b[0], b[3], b[2]) for b in best]


def ranked(new: list[tuple[int, int, str] | None], ranks: list[int]) -> list[int]:
    """The order of the new paths: that of those they extend, then that of their last edits."""
    order = sorted((ranks[x[1]], x[2], q) for q, x in enumerate(new) if x)
    out = [FAR] * 4
    for k, (_, _, q) in enumerate(order):
        out[q] = k
    return out


def sweep(kinds: list[tuple[str, bool, bool]], entry: int) -> tuple[list[int], list[int]]:
    """Costs and orders of the best paths from one state to each, without the paths."""
    costs, ranks = [FAR] * 4, [FAR] * 4
    costs[entry] = ranks[entry] = 0
    for kind in kinds:
        new = step(costs, ranks, kind)
        ranks = ranked(new, ranks)
        costs = [x[0] if x else FAR for x in new]
    return costs, ranks


class Survivors:
    """The best path into each state, as a tree of back pointers with reference counts.

    A path that costs more than another could catch up with (see AT_MOST) is dropped: it can be part
    of no cheapest result.  Without that the path that deletes all would never meet the others.
    """

    def __init__(self, entry: int = START):
        self.costs, self.ranks = [FAR] * 4, [FAR] * 4
        self.costs[entry] = self.ranks[entry] = 0
        self.root = self.count = 0
        #: node -> [parent, edits, references, sum of its children's numbers]: a last child is known by the sum.
        self.nodes: dict[int, list] = {0: [-1, "", 1, 0]}
        self.ends: list[int | None] = [0 if q == entry else None for q in range(4)]

    def push(self, kind: tuple[str, bool, bool]) -> list[str]:
        """Takes a row; returns the edits, by row, that are settled now."""
        new = step(self.costs, self.ranks, kind)
        new = [x and (None if any(new[r] and x[0] > new[r][0] + most for (r, q), most in AT_MOST.items() if q == k) else x) for k, x in enumerate(new)]
        old = self.ends
        self.ends = [None] * 4
        for q, x in enumerate(new):
            if x:
                self.count += 1
                parent = old[x[1]]
                self.nodes[self.count] = [parent, x[2], 1, 0]
                self.nodes[parent][2] += 1
                self.nodes[parent][3] += self.count
                self.ends[q] = self.count
        for end in old:
            if end is not None:
                self.release(end)
        self.ranks = ranked(new, self.ranks)
        self.costs = [x[0] if x else FAR for x in new]
        return self.settled()

    def release(self, node: int) -> None:
        while node >= 0:
            self.nodes[node][2] -= 1
            if self.nodes[node][2]:
                return
            parent = self.nodes.pop(node)[0]
            if parent >= 0:
                self.nodes[parent][3] -= node
            node = parent

    def settled(self) -> list[str]:
        out = []
        while self.nodes[self.root][2] == 1 and self.nodes[self.root][3]:
            child = self.nodes.pop(self.root)[3]
            self.root = child
            self.nodes[child][0] = -1
            out.append(self.nodes[child][1])
        return out

    def close(self, beyond: list[int]) -> tuple[int, int, list[str]]:
        """(cost, last state, edits still open) of the best path, given what each last state costs from here on."""
        cost, _, q = min((self.costs[q] + beyond[q], self.ranks[q], q) for q in range(4) if self.ends[q] is not None)
        words, node = [], self.ends[q]
        while node != self.root:
            words.append(self.nodes[node][1])
            node = self.nodes[node][0]
        return cost - beyond[q], q, words[::-1]


def beyond_end() -> list[int]:
    return [INSERT * len(ENDING[q]) for q in range(4)]


def repair(rows: Iterable[tuple[str, str, bool, bool]], entry: int = START, beyond: list[int] | None = None) -> Iterator[tuple[str, list[str], int]]:
    """(edits, repaired ``role:text`` lines, cost so far) bit by bit for rows (role, text, must go, truncated) in order.

    Holds the rows whose edits are still open.  With ``beyond`` the rows are followed by
    others, and nothing is inserted at the end.
    """
    survivors, open_rows, state = Survivors(entry), [], entry
    at = 0

    def apply(words: list[str]) -> tuple[str, list[str]]:
        nonlocal state, at
        lines = []
        for word in words:
            role, text = open_rows[at]
            at += 1
            for letter in word:
                if letter == "D":
                    continue
                if letter == "K":
                    state = kept_as(state, role[:1])
                    lines.append(f"{role}:{text}")
                else:
                    state = NEXT[state]
                    lines.append(f"{ROLES[state]}:{text if letter == 'R' else ''}")
        if at > 1000 or at == len(open_rows):
            del open_rows[:at]
            at = 0
        return "".join(words), lines

    for role, text, must_go, truncated in rows:
        open_rows.append((role, text))
        if words := survivors.push(kind_of(role[:1], must_go, truncated)):
            yield *apply(words), 0
    cost, last, words = survivors.close(beyond or beyond_end())
    edits, lines = apply(words)
    if beyond is None:
        for _ in ENDING[last]:
            state = NEXT[state]
            lines.append(f"{ROLES[state]}:")
        edits, cost = edits + ENDING[last], cost + INSERT * len(ENDING[last])
    yield edits, lines, cost


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live): rows after the stated damage; dropped rows stay as not live, without text.

    Nulls in role and text become one space, as they do in the hashed key.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("h"))
    text = F.when(F.col("h") <= 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") != 0).alias("live"), F.explode(copies).alias("copy"))


def in_order(rows: DataFrame) -> DataFrame:
    """(block, pos, ...): rows by conversation and turn, nulls first, in blocks of 16 MB or so, written.

    Rows of one turn follow by role, by the first 100 characters of the text, and by a hash of it.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.length("text") + 64), F.count("*")).first()
    blocks = max((size[0] or 0) // BLOCK_BYTES, min(spark.sparkContext.defaultParallelism, size[1] // 1000)) + 1
    cut = F.rtrim("text", F.lit(SPACE))
    keys = ["conv_id", "turn", "role", "_first", "_hash", "_place"]
    keyed = rows.withColumns({"_first": F.substring("text", 1, 100), "_hash": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(blocks, *keys).sortWithinPartitions(*keys)
    message = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    pos = F.monotonically_increasing_id()
    flags = {"blank": cut == "", "open": ~F.right(cut, F.lit(1)).isin(".", "!", "?")}
    made = dealt.select(F.shiftright(pos, 33).alias("block"), pos.alias("pos"), "conv_id", "turn", "role", "text", "live", *[v.alias(k) for k, v in flags.items()], message.alias("message"))
    return written(made, "turns")


def runs(table: pa.Table, names: list[str]) -> Iterator[tuple[object, list[tuple]]]:
    """The rows of a block in order, conversation by conversation."""
    table = table.sort_by("pos")
    columns = [table.column(n).to_pylist() for n in ("conv_id", *names)]
    for conv, rows in itertools.groupby(zip(*columns, strict=True), key=lambda r: (r[0] is None, r[0])):
        yield conv[1], [r[1:] for r in rows]


def first_sights(turns: DataFrame) -> DataFrame:
    """(block, pos) of the first row of each message (role and text) of a conversation; messages meet by their SHA-256."""
    seen = turns.where("live and not blank").groupBy("conv_id", "message").agg(F.min("pos").alias("pos"))
    return seen.select(F.shiftright("pos", 33).alias("block"), "pos")


def passages(turns: DataFrame, firsts: DataFrame) -> DataFrame:
    """(conv_id, block, entry, beyond, last) for the conversations that lie in several blocks.

    ``entry``: the state in which the best path comes to the block.  ``beyond``: what each state at its end costs from there on.
    """
    kind = turns.schema["conv_id"].dataType
    wide = written(turns.groupBy("conv_id").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select(F.col("conv_id").alias("wide")), "wide")
    light = turns.select("block", "pos", "conv_id", "live", "blank", "open", F.substring("role", 1, 1).alias("initial"))
    light = light.join(small_side(wide, 16), F.col("conv_id").eqNullSafe(F.col("wide")), "left_semi")
    fields = [StructField("conv_id", kind), *StructType.fromDDL("block long, costs array<long>, ranks array<long>").fields]

    def matrices(left: pa.Table, right: pa.Table) -> pa.Table:
        first, out = set(right.column("pos").to_pylist()), []
        for conv, rows in runs(left, ["block", "pos", "live", "blank", "open", "initial"]):
            kinds = [kind_of(i, blank or pos not in first, cut) for _, pos, live, blank, cut, i in rows if live]
            both = [sweep(kinds, q) for q in range(4)]
            out.append((conv, rows[0][0], [c for costs, _ in both for c in costs], [r for _, ranks in both for r in ranks]))
        return table_of(out, fields, left.schema.field("conv_id").type)

    blocks = written(light.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(matrices, StructType(fields)), "matrices")
    after = [StructField("conv_id", kind), *StructType.fromDDL("block long, entry int, beyond array<long>, last boolean").fields]

    def chained(own: pa.Table) -> pa.Table:
        rows = sorted(zip(*(own.column(n).to_pylist() for n in ("block", "costs", "ranks")), strict=True))
        beyond = [beyond_end()]
        for _, costs, _ in reversed(rows):
            beyond.append([min(costs[4 * q + r] + beyond[-1][r] for r in range(4)) for q in range(4)])
        beyond, state, out = beyond[::-1], START, []
        conv = own.column("conv_id")[0].as_py()
        for k, (block, costs, ranks) in enumerate(rows):
            out.append((conv, block, state, beyond[k + 1], k + 1 == len(rows)))
            state = min((costs[4 * state + r] + beyond[k + 1][r], ranks[4 * state + r], r) for r in range(4))[2]
        return table_of(out, after, own.schema.field("conv_id").type)

    return written(blocks.groupBy("conv_id").applyInArrow(chained, StructType(after)), "passages")


def table_of(rows: list[tuple], fields: list[StructField], conv_type: pa.DataType) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table({f.name: pa.array(list(c), conv_type if f.name == "conv_id" else kinds[f.dataType.simpleString()]) for f, c in zip(fields, columns, strict=True)})


FAULTS = ("blank", "duplicate", "truncated")
PIECE = "block long, part int, blank long, duplicate long, truncated long, illegal long, cost long, audit string, low long, high long, turns long, head string, tail string, n long, repaired binary, sha256 string"
LEGAL = ("su", "ua", "au")


def piece_of(rows: list[tuple], first: set[int], entry: int, beyond: list[int] | None, whole: bool) -> Iterator[tuple]:
    """Rows of PIECE, less the block, for the share of a conversation that a block holds: one, and more where the text is long."""
    live = [r for r in rows if r[3]]
    gone = [blank or pos not in first for pos, _, _, _, blank, _, _ in live]
    counts = [sum(r[4] for r in live), sum(g and not r[4] for g, r in zip(gone, live, strict=True)), sum(r[5] and not g for g, r in zip(gone, live, strict=True))]
    initials = [r[2][:1] for r in live]
    illegal = sum(a + b not in LEGAL for a, b in itertools.pairwise(initials))
    turns = [r[1] for r in live if r[1] is not None]
    audit, cost, digest, held, size, parts = [], 0, hashlib.sha256(), [], 0, []
    started = False
    for edits, lines, cost in repair(((r[2], r[6], g, r[5]) for r, g in zip(live, gone, strict=True)), entry, beyond):  # noqa: B007
        audit.append(edits)
        for line in lines:
            data = (b"\n" if started else b"") + line.encode()
            started = True
            if whole:
                digest.update(data)
                continue
            held.append(data)
            size += len(data)
            if size >= PART_BYTES:
                joined = b"".join(held)
                parts += [joined[k : k + PART_BYTES] for k in range(0, len(joined), PART_BYTES)]
                held, size = [], 0
    if held:
        parts.append(b"".join(held))
    low, high = (turns[0], turns[-1]) if turns else (None, None)
    ends = (initials[0], initials[-1]) if initials else (None, None)
    yield 0, *counts, illegal, cost, "".join(audit), low, high, len(set(turns)), *ends, len(live), parts[0] if parts else None, digest.hexdigest() if whole else None
    for k, part in enumerate(parts[1:], 1):
        yield k, 0, 0, 0, 0, 0, "", None, None, 0, None, None, 0, part, None


def put_together(rows: Iterator[Row]) -> Iterator[tuple]:
    """One row for each conversation from its pieces, which come sorted by conversation, block and part, as a stream."""
    for conv, pieces in itertools.groupby(rows, key=lambda r: (r["conv_id"] is None, r["conv_id"])):
        sums, audit, digest, given = dict.fromkeys((*FAULTS, "illegal", "cost", "turns"), 0), [], hashlib.sha256(), None
        low = high = tail = None
        started = False
        for p in pieces:
            for k in sums:
                sums[k] += p[k]
            audit.append(p["audit"])
            given = p["sha256"] or given
            if p["repaired"]:
                if started and p["part"] == 0:
                    digest.update(b"\n")
                digest.update(p["repaired"])
                started = True
            if p["n"]:
                sums["illegal"] += tail is not None and tail + p["head"] not in LEGAL
                tail = p["tail"]
            if p["low"] is not None:
                sums["turns"] -= p["low"] == high
                low, high = p["low"] if low is None else low, p["high"]
        gaps = 0 if low is None else high - low + 1 - sums["turns"]
        yield conv[1], gaps if gaps < 1 << 63 else None, *(sums[k] for k in (*FAULTS, "illegal", "cost")), "".join(audit), given or digest.hexdigest()


def repairs(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: gaps, faults, cost, audit and digest of the repaired text, after the stated damage.

    Null conv_ids are one conversation; null turns come first; null and empty texts
    are blank.  Rows of one turn follow by role and text.  A role that does not
    start with s, u or a (or is empty) cannot be kept.  Repeated rows count as
    duplicates.  gaps is null beyond the range of a long.  Other columns are not read;
    an empty table gives no rows.
    """
    turns = in_order(damaged(conversations))
    firsts = written(first_sights(turns), "firsts")
    ways = passages(turns, firsts)
    kind = turns.schema["conv_id"].dataType
    known = firsts.select("block", "pos", F.lit(None).cast(kind).alias("conv_id"), F.lit(None).cast("int").alias("entry"), F.lit(None).cast("array<long>").alias("beyond"), F.lit(None).cast("boolean").alias("last"))
    known = known.unionByName(ways.select("block", F.lit(None).cast("long").alias("pos"), "conv_id", "entry", "beyond", "last"))
    fields = [StructField("conv_id", kind), *StructType.fromDDL(PIECE).fields]

    def pieces(left: pa.Table, right: pa.Table) -> pa.Table:
        first, way = set(), {}
        for pos, conv, entry, beyond, last in zip(*(right.column(n).to_pylist() for n in ("pos", "conv_id", "entry", "beyond", "last")), strict=True):
            if pos is None:
                way[conv] = (entry, None if last else beyond)
            else:
                first.add(pos)
        out = []
        for conv, rows in runs(left, ["block", "pos", "turn", "role", "live", "blank", "open", "text"]):
            block = rows[0][0]
            entry, beyond = way.get(conv, (START, None))
            out += [(conv, block, *p) for p in piece_of([r[1:] for r in rows], first, entry, beyond, conv not in way)]
        return table_of(out, fields, left.schema.field("conv_id").type)

    left = turns.select("block", "pos", "conv_id", "turn", "role", "live", "blank", "open", "text")
    made = left.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(pieces, StructType(fields))
    sorted_pieces = made.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    schema = StructType([StructField("conv_id", kind), *StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").fields])
    return turns.sparkSession.createDataFrame(sorted_pieces.rdd.mapPartitions(put_together), schema, verifySchema=False)
