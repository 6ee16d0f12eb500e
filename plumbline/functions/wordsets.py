"""Word-set similarities (``similarity.token_set``) of many pairs of texts at once, as arrays.

A text is its sorted set of words, each with a space behind it; weights count these
characters.  Where n is the weight of the words that two texts share and c the longest
common subsequence of what is left of both, their similarity is 200 (n + c - 1) / (both
weights - 2), or that of the shared words with either text, whichever is more.

Texts are put in classes by which of the most frequent words they hold.  All pairs of two
classes share the same frequent words, so these are cut out first, and the subsequences of
what is left are found for a block of pairs at a time: a pair is one number (or
several, beyond 64 characters) whose bits are the places of one text, and each step takes one
character of the other.  The few pairs that share further words are done apart, with these masked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Classes of a set of texts, pairs that make a pair of classes worth while, pairs in a block, texts on its one side.
CLASSES, LEAST_PAIRS, BLOCK, ROWS = 24, 1 << 12, 1 << 14, 256
#: Pairs, and texts at least, compared at a time while a component grows; texts that may begin one.
STEP, LEAST_ROWS, SEEDS = 1 << 18, 64, 16
Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


def expanded(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k its number and start, start + 1, ... as often as counts[k] says."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[which]


def bits(start: np.ndarray, stop: np.ndarray, parts: int) -> np.ndarray:
    """Numbers of 64 bits (parts by texts) with ones in the places from start to stop."""
    at = 64 * np.arange(parts)[:, None]
    low, high = np.clip(start - at, 0, 64).astype(np.uint64), np.clip(stop - at, 0, 64).astype(np.uint64)

    def ones(n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, ~np.uint64(0) >> (np.uint64(64) - np.maximum(n, np.uint64(1))), np.uint64(0))

    return ones(high) & ~ones(low)


class Reduced:
    """Some texts without some of their words: characters as codes (0 behind the end), weights left, which words are kept and where."""

    def __init__(self, sets: WordSets, texts: np.ndarray, without: int):
        weights, codes = sets.weights[texts], sets.codes[texts]
        self.kept = (weights > 0) & ((np.uint64(without) >> sets.bit[texts]) & np.uint64(1) == 0)
        self.weights = np.where(self.kept, weights, 0)
        self.rest = self.weights.sum(axis=1)
        self.starts = self.weights.cumsum(axis=1) - self.weights
        here = np.take_along_axis(self.kept, sets.slot[texts], 1) & (codes > 0)
        self.codes = np.zeros((len(texts), int(self.rest.max(initial=0))), codes.dtype)
        self.codes[np.arange(self.codes.shape[1]) < self.rest[:, None]] = codes[here]

    def table(self, rows: slice, letters: int) -> np.ndarray:
        """The places of each letter in each text (parts, letters, texts); of the narrowest numbers that hold them."""
        codes = self.codes[rows]
        size = int(self.rest[rows].max(initial=0))
        kind = next((t for t, n in ((np.uint16, 16), (np.uint32, 32)) if size <= n), np.uint64)
        width = 8 * np.dtype(kind).itemsize
        out = np.zeros((max(1, -(-size // width)), letters, len(codes)), kind)
        each = np.arange(len(codes))
        for p in range(size):
            out[p // width, codes[:, p], each] |= kind(1 << p % width)
        out[:, 0] = 0
        return out


def step(row: np.ndarray, hit: np.ndarray, spare: np.ndarray) -> None:
    """One character of the other texts: ``row`` (parts first) after the places ``hit`` of it; what is zero in the end is common."""
    hit &= row
    if len(row) == 1:
        np.add(row, hit, out=spare)
    else:
        carry = np.zeros(row.shape[1:], row.dtype)
        for k in range(len(row)):
            np.add(row[k], hit[k], out=spare[k])
            over = spare[k] < row[k]
            spare[k] += carry
            carry = (over | (spare[k] < carry)).astype(row.dtype)
    row -= hit
    row |= spare


def common(row: np.ndarray) -> np.ndarray:
    return np.bitwise_count(~row).sum(axis=0, dtype=np.int64) if len(row) > 1 else np.bitwise_count(~row[0])


class WordSets:
    """The sets of words of some texts; compares any of them with any others."""

    def __init__(self, texts: list[str]):
        sets = [sorted(set(t.split())) for t in texts]
        counts = np.fromiter(map(len, sets), np.int64, len(sets))
        held = np.arange(max(1, int(counts.max(initial=0)))) < counts[:, None]
        ids: dict[str, int] = {}
        flat = [w for s in sets for w in s]
        self.words, self.weights = np.full(held.shape, -1, np.int64), np.zeros(held.shape, np.int64)
        self.words[held] = [ids.setdefault(w, len(ids)) for w in flat]
        self.weights[held] = [len(w) + 1 for w in flat]
        self.size = self.weights.sum(axis=1)
        length = int(self.size.max(initial=0))
        codes = np.frombuffer("".join([" ".join(s).ljust(length) for s in sets]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(sets), length)
        seen = np.zeros(int(codes.max(initial=0)) + 1, np.int32)
        seen[codes.ravel()] = 1
        self.codes = np.where(np.arange(length) < self.size[:, None], np.cumsum(seen, dtype=np.int32)[codes], 0)
        self.letters = int(seen.sum()) + 1
        ends = np.where(held, self.weights.cumsum(axis=1), length + 1)
        self.slot = np.zeros(codes.shape, np.int64)
        for k in range(held.shape[1] - 1):
            self.slot += np.arange(length) >= ends[:, k : k + 1]
        self.classify(held, len(ids))

    def classify(self, held: np.ndarray, n_words: int) -> None:
        """Flags of the most frequent words, and with the first of these, of the first two, ... the classes of texts."""
        n = np.bincount(self.words[held], minlength=n_words)
        often = [int(w) for w in np.argsort(-n, kind="stable")[:CLASSES] if n[w] > 1 and n[w] * 16 >= len(held)]
        self.bit, self.flags, self.flag_weights = np.full(held.shape, 63, np.uint64), np.zeros(len(held), np.uint64), []
        self.levels = [(np.uint64(0), 1)]
        for k, w in enumerate(often):
            at = self.words == w
            flags = self.flags | (at.any(axis=1).astype(np.uint64) << np.uint64(k))
            if (classes := len(np.unique(flags))) > CLASSES:
                break
            self.flags = flags
            self.bit[at] = k
            self.flag_weights.append(int(self.weights[at][0]))
            self.levels.append((np.uint64((2 << k) - 1), classes))

    def compare(self, rows: np.ndarray, others: np.ndarray, threshold: float, within: bool = False) -> Iterator[Hits]:
        """(row, other, similarity) of the pairs at or above the threshold, some at a time; ``within``: of one list with itself, each pair once."""
        rows, others = rows[self.size[rows] > 0], others[self.size[others] > 0]
        mask = next(m for m, n in reversed(self.levels) if n == 1 or n * n * LEAST_PAIRS <= len(rows) * len(others))
        left = self.grouped(rows, mask)
        right = left if within else self.grouped(others, mask)
        reduced: dict[tuple[bool, int, int], Reduced] = {}
        for x in left:
            for y in right:
                if within and x > y:
                    continue
                shared = x & y
                a = reduced.get((False, x, shared)) or reduced.setdefault((False, x, shared), Reduced(self, left[x], shared))
                b = a if within and x == y else reduced.get((True, y, shared)) or reduced.setdefault((True, y, shared), Reduced(self, right[y], shared))
                weight = sum(w for k, w in enumerate(self.flag_weights) if shared >> k & 1)
                for p, q, score in self.classes(left[x], right[y], a, b, weight, threshold, within and x == y):
                    if len(p):
                        yield left[x][p], right[y][q], score

    def grouped(self, texts: np.ndarray, mask: np.uint64) -> dict[int, np.ndarray]:
        flags = self.flags[texts] & mask
        return {int(f): texts[flags == f] for f in np.unique(flags)}

    def classes(self, left: np.ndarray, right: np.ndarray, a: Reduced, b: Reduced, weight: int, threshold: float, once: bool) -> Iterator[Hits]:
        """Hits, by their places, of two classes that share words of a weight; ``once``: of one with itself, the second place after the first."""
        sizes, others = self.size[left] - 1, self.size[right] - 1
        kept = self.words[right][b.kept]
        order = np.argsort(kept, kind="stable")
        kept, place, slots = kept[order], *(k[order] for k in np.nonzero(b.kept))
        for at in range(0, len(left), ROWS):
            rows = slice(at, min(at + ROWS, len(left)))
            table = a.table(rows, self.letters)
            done, hits = self.further(left, right, a, b, rows, table, weight, threshold, (kept, place, slots), once)
            for x, y, score in self.block(a, b, rows, table, weight, sizes, others, threshold, once):
                keys = x * len(right) + y
                good = y > x if once else np.ones(len(x), bool)
                if len(done):
                    good &= done[np.minimum(np.searchsorted(done, keys), len(done) - 1)] != keys
                yield x[good], y[good], score[good]
            yield hits

    def block(self, a: Reduced, b: Reduced, rows: slice, table: np.ndarray, weight: int, sizes: np.ndarray, others: np.ndarray, threshold: float, once: bool) -> Iterator[Hits]:
        """Hits of some rows with all others of a class, as if they shared no further word."""
        rest, size = a.rest[rows], sizes[rows]
        high = max(0, weight - 1)
        own = (rest == 0) | (200.0 * high >= threshold * (high + size)) & (weight > 0)
        own_b = (b.rest == 0) | (200.0 * high >= threshold * (high + others)) & (weight > 0)
        need, need_b = threshold * size / 200 - weight + 1 - 1e-6, threshold * others / 200
        # what is left of either text bounds what both have in common
        possible = np.flatnonzero((b.rest >= need.min() + need_b) & (rest.max() >= need.min() + need_b) | own_b | own.any())
        possible = possible[possible > rows.start] if once else possible
        many = max(1, BLOCK // len(rest))
        for at in range(0, len(possible), many):
            chosen = possible[at : at + many]
            codes = np.ascontiguousarray(b.codes[chosen, : int(b.rest[chosen].max(initial=0))].T)
            row = np.full((len(table), len(chosen), len(rest)), np.iinfo(table.dtype).max, table.dtype)
            hit, spare = np.empty_like(row), np.empty_like(row)
            for code in codes:
                for k in range(len(table)):
                    np.take(table[k], code, axis=0, out=hit[k], mode="clip")
                step(row, hit, spare)
            c = common(row)
            y, x = np.nonzero((c >= need + need_b[chosen, None]) | own | own_b[chosen, None])
            c, y = c[y, x].astype(np.int64), chosen[y]
            yield scored(x + rows.start, y, c, np.full(len(x), weight), rest[x], b.rest[y], size[x], others[y], threshold)

    def further(self, left: np.ndarray, right: np.ndarray, a: Reduced, b: Reduced, rows: slice, table: np.ndarray, weight: int, threshold: float, index: tuple, once: bool) -> tuple[np.ndarray, Hits]:
        """The pairs of some rows with all others that share further words (sorted, as row * others + other), and the hits among them."""
        kept, place, slots = index
        x, k = np.nonzero(a.kept[rows])
        words = self.words[left[rows]][x, k]
        low = np.searchsorted(kept, words)
        which, at = expanded(low, np.searchsorted(kept, words, "right") - low)
        x, k, y, j = x[which] + rows.start, k[which], place[at], slots[at]
        if once:
            after = y > x
            x, k, y, j = x[after], k[after], y[after], j[after]
        pairs, of = np.unique(x * len(right) + y, return_inverse=True)
        weights = a.weights[x, k]
        more = np.bincount(of, weights, len(pairs)).astype(np.int64)
        px, py = pairs // len(right), pairs % len(right)
        shared, rest, rest_b = weight + more, a.rest[px] - more, b.rest[py] - more
        size, others = self.size[left[px]] - 1, self.size[right[py]] - 1
        able = (200.0 * (shared + np.minimum(rest, rest_b) - 1) >= (threshold - 1e-6) * (size + others)) | (rest == 0) | (rest_b == 0)
        able |= (200.0 * (shared - 1) >= (threshold - 1e-6) * (shared - 1 + np.minimum(size, others)))
        new = np.cumsum(able) - 1
        own = able[of]
        x, k, y, j, of, weights = x[own], k[own], y[own], j[own], new[of[own]], weights[own]
        px, py, shared, rest, rest_b, size, others = (v[able] for v in (px, py, shared, rest, rest_b, size, others))
        masks = np.zeros((len(table), len(px)), np.uint64)
        for part, m in enumerate(bits(a.starts[x, k], a.starts[x, k] + weights, len(table))):
            np.bitwise_or.at(masks[part], of, m)
        masks = ~masks.astype(table.dtype)
        found = []
        for at in range(0, len(px), BLOCK):
            some = slice(at, min(at + BLOCK, len(px)))
            codes = b.codes[py[some]]
            inside = (of >= some.start) & (of < some.stop)
            which, place = expanded(b.starts[y, j][inside], weights[inside])
            codes[of[inside][which] - at, place] = 0
            row = np.full((len(table), len(codes)), np.iinfo(table.dtype).max, table.dtype)
            spare, mask, col = np.empty_like(row), masks[:, some], px[some] - rows.start
            for code in codes.T:
                step(row, table[:, code, col] & mask, spare)
            found.append(common(row).astype(np.int64))
        c = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pairs, scored(px, py, c, shared, rest, rest_b, size, others, threshold)

    def links(self, labels: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """Similar pairs that join what is connected: all pairs matter unless labels or earlier ones have joined them.

        A component grows by comparing what it has taken in with what is still outside, so that large ones cost little
        beyond their size; what lies outside large ones is compared pair by pair.
        """
        _, labels = np.unique(labels, return_inverse=True)
        by_label = np.argsort(labels, kind="stable")
        counts = np.bincount(labels)
        ends = np.cumsum(counts)
        outside, out = np.ones(len(labels), bool), []

        def members(found: list[int] | np.ndarray) -> np.ndarray:
            return by_label[expanded(ends[found] - counts[found], counts[found])[1]]

        while len(left := np.flatnonzero(outside)) ** 2 > STEP:
            n = np.bincount(labels[left])
            if n.max() * 8 >= len(left):
                seed = np.argmax(n)
            else:
                seeds = left[np.linspace(0, len(left) - 1, SEEDS).astype(int)]
                degree = np.bincount(np.concatenate([x for x, _, _ in self.compare(seeds, left, threshold)] or [seeds[:0]]), minlength=len(labels))
                seed = labels[seeds[np.argmax(degree[seeds])]]
            queue = members([seed])
            outside[queue] = False
            taken = 0
            while len(queue) and len(left := np.flatnonzero(outside)):
                batch, queue = np.split(queue, [max(LEAST_ROWS, STEP // len(left))])
                taken += len(batch)
                # the shorter list gives the rows, since each 256 of these are prepared anew
                turned = len(batch) > len(left)
                for x, y, _ in self.compare(left, batch, threshold) if turned else self.compare(batch, left, threshold):
                    x, y = (y, x) if turned else (x, y)
                    x, y = x[outside[y]], y[outside[y]]
                    found, first = np.unique(labels[y], return_index=True)
                    out += zip(x[first].tolist(), y[first].tolist(), strict=True)
                    queue = np.concatenate([queue, new := members(found)])
                    outside[new] = False
            if taken * 8 < len(left):
                break
        left = np.flatnonzero(outside)
        return out + self.joining(left, left, labels, threshold, True)

    def joining(self, rows: np.ndarray, others: np.ndarray, labels: np.ndarray, threshold: float, within: bool = False) -> list[tuple[int, int]]:
        """Of all similar pairs of two lists those that join labels, one after the other."""
        of, out = np.unique(labels, return_inverse=True)[1], []
        for x, y, _ in self.compare(rows, others, threshold, within):
            while len(apart := np.flatnonzero(of[x] != of[y])):
                x, y = x[apart], y[apart]
                out.append((int(x[0]), int(y[0])))
                of[of == of[x[0]]] = of[y[0]]
        return out


def scored(x: np.ndarray, y: np.ndarray, c: np.ndarray, shared: np.ndarray, rest: np.ndarray, rest_b: np.ndarray, size: np.ndarray, size_b: np.ndarray, threshold: float) -> Hits:
    """The similarities as ``token_set`` has them, of the pairs that reach the threshold."""
    n = shared - 1
    score = 200.0 * (shared + c - 1) / np.maximum(size + size_b, 1)
    for s in (size, size_b):
        score = np.where(shared > 0, np.maximum(score, 200.0 * n / np.maximum(n + s, 1)), score)
    score = np.where((shared > 0) & ((rest == 0) | (rest_b == 0)), 100.0, score)
    good = score >= threshold
    return x[good], y[good], score[good]
