"""Repairs against a search over all edit sequences, and over conversations that lie in many blocks."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from plumbline.llm import conversations as c

SF = "/root/testdata/sf0.001"


def damage(rows):
    """Rows (conv_id, turn, role, text) after the damage, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if h == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def plain(rows):
    """The contract's row for one conversation: a uniform-cost search over (cost, audit) with whole strings."""
    seen, kinds = set(), []
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        fault = None
        if not re.search(r"[^\x20\x09-\x0D]", text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        kinds.append(fault)
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0

    def allowed(roles):
        return re.fullmatch(r"(s(u(au)*a?)?|u(au)*a?)?", roles)

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, roles, lines = heapq.heappop(heap)
        state = (k, roles[-1:])
        if state in done:
            continue
        done.add(state)
        if k == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()

        def push(more, letter, role, line, at, cost=cost, audit=audit, roles=roles, lines=lines):
            if allowed(roles + role):
                heapq.heappush(heap, (cost + more, audit + letter, at, roles + role, (*lines, line) if line is not None else lines))

        for role in ("user", "assistant"):
            push(5, "I", role[0], f"{role}:", k)
        if k < len(rows):
            _, role, text = rows[k]
            push(2, "D", "", None, k + 1)
            if kinds[k] not in ("blank", "duplicate"):
                extra = 5 if kinds[k] == "truncated" else 0
                if role[:1] in tuple("sua"):
                    push(extra, "K", role[0], f"{role}:{text}", k + 1)
                for new in ("user", "assistant"):
                    push(1 + extra, "R", new[0], f"{new}:{text}", k + 1)
    raise AssertionError


def allowed_next(last, role):
    return role in {"": "su", "s": "u", "u": "a", "a": "u"}[last]


def expected(rows):
    return {k: best(v) for k, v in damage(rows).items()}


def best(rows):
    """Like ``plain``, with cost and audit of every state by plain dynamic programming over whole strings."""
    head = plain_counts(rows)
    order = {"": (0, "", ())}

    def inserted(now):
        for _ in range(3):
            for last, (cost, audit, lines) in list(now.items()):
                for role in ("user", "assistant"):
                    if allowed_next(last, role[0]):
                        new = (cost + 5, audit + "I", (*lines, f"{role}:"))
                        if role[0] not in now or new[:2] < now[role[0]][:2]:
                            now[role[0]] = new
        return now

    now = inserted(order)
    seen = set()
    for _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        gone = blank or (role, text) in seen
        seen.add((role, text))
        extra = 0 if gone or re.findall(r"[^\x20\x09-\x0D]", text)[-1] in ".!?" else 5
        after = {}

        def put(last, new):
            if last not in after or new[:2] < after[last][:2]:
                after[last] = new

        for last, (cost, audit, lines) in now.items():
            put(last, (cost + 2, audit + "D", lines))
            if not gone:
                if role[:1] and role[:1] in "sua" and allowed_next(last, role[0]):
                    put(role[0], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    if allowed_next(last, other[0]):
                        put(other[0], (cost + 1 + extra, audit + "R", (*lines, f"{other}:{text}")))
        now = inserted(after)
    cost, audit, lines = min((v for k, v in now.items() if k in ("", "a")), key=lambda v: v[:2])
    return *head, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain_counts(rows):
    return plain(rows)[:5]


def drawn(seed, convs, length, roles=("user", "assistant", "system", "user", "assistant", "tool", None, "")):
    r = random.Random(seed)
    words = ["Yes.", "no", "Why?", " ", "", "Good!\n", "aé b.", None]
    return [(conv, r.choice([k, k, k, k, k - 1, None]), r.choice(roles), r.choice(words) if r.random() < 0.4 else f"word {r.randrange(99)}{r.choice('.?! x')}") for conv in convs for k in range(r.randrange(length))]


def rows_of(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def test_the_two_plain_searches_agree():
    for own in damage(drawn(5, range(60), 6)).values():
        assert plain(own) == best(own)


def test_against_plain_search(spark):
    rows = drawn(1, [*range(150), None], 12)
    assert rows_of(c.repairs(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_one_conversation_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK_BYTES", 700)
    monkeypatch.setattr(c, "PART_BYTES", 50)
    for seed in range(3):
        rows = drawn(seed, [1, 2, 3], 12) + [(9, k, ("user", "assistant", "user", "tool")[(k * k + seed) % 4], f"text {k % 40}{'.x'[k % 5 == 0]}") for k in range(400)] + [(None, k, "user", "x.") for k in range(60)]
        turns = c.in_order(c.damaged(spark.createDataFrame(rows, SCHEMA)))
        assert turns.where("conv_id = 9").select("block").distinct().count() > 5
        assert rows_of(c.repairs(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_blocks_give_what_one_run_gives():
    r = random.Random(4)
    for _ in range(200):
        kinds = [c.kind_of(r.choice("suaat-"), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randrange(1, 15))]
        cut = r.randrange(len(kinds) + 1)
        end = c.beyond_end()
        whole = c.sweep(kinds, c.START)
        left, right = c.sweep(kinds[:cut], c.START), [c.sweep(kinds[cut:], q) for q in range(4)]
        beyond = [min(right[q][0][x] + end[x] for x in range(4)) for q in range(4)]
        assert min(a + b for a, b in zip(whole[0], end, strict=True)) == min(a + b for a, b in zip(left[0], beyond, strict=True))


def test_survivors_hold_what_is_open():
    s, most, given = c.Survivors(), 0, 0
    for k in range(5000):
        given += len(s.push(c.kind_of("ua"[k % 2], False, False)))
        most = max(most, len(s.nodes))
    assert most < 30 and given > 4980
    s, most = c.Survivors(), 0
    for _ in range(2000):
        s.push(c.kind_of("s", False, False))
        most = max(most, len(s.nodes))
    cost, _, words = s.close(c.beyond_end())
    assert cost == 2000 and most < 10000 and set("".join(words)) <= set("KRDI")


def test_given_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    assert rows_of(c.repairs(table)) == expected([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("rows", [[], [(5, 1, "user", None)], [(1, 2**63 - 1, "user", "a."), (1, -(2**63), "user", "b."), (2, None, None, None)]])
def test_odd_tables(spark, rows):
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as block", "2 as pos", "3 as `a.b`", "4 as live")
    want = {k: (v[0] if v[0] < 1 << 63 else None, *v[1:]) for k, v in expected(rows).items()}
    assert rows_of(c.repairs(wide)) == want


def test_dropped_conversation(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    got = rows_of(c.repairs(spark.createDataFrame([(gone, 1, "user", "Hello.")], SCHEMA)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_text_keys(spark):
    got = rows_of(c.repairs(spark.createDataFrame([("x", 1, "user", "Hello."), ("x", 2, "assistant", "Yes.")], "conv_id string, turn int, role string, text string")))
    assert list(got) == ["x"]
