"""What a delimited file looks like: encoding, delimiter, header; from its first 64 KB, on the driver."""

from __future__ import annotations

import csv
import io
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

SAMPLE_BYTES = 64 << 10
DELIMITERS = (",", ";", "\t", "|", ":")
NUMERIC = re.compile(r"^[\s$€£₹+-]*[\d.,]+%?\s*$")


@dataclass
class Dialect:
    encoding: str
    delimiter: str
    confidence: float
    header_row: int
    columns: list[str]
    notes: list[str] = field(default_factory=list)


#: Code pages that are told apart by what they make of the bytes, in order of preference at equal likelihood, each with the
#: letters beyond ASCII that its languages use most, most frequent first.
CODE_PAGES = {
    "cp1252": "éäöüßèàñáíóøåæúçêôîâûëïãõìòùœ",
    "cp1250": "áéíěščřžýůąęłóśżźćńőűöüăâîșțďťňľĺŕđ",
    "cp1251": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёіїєў",
    "koi8-r": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё",
    "cp1253": "αοιετσνηυρπκμλςωγδχθφβξζψάέήίόύώ",
    "cp1254": "ıİşŞğĞüöçâîû",
    "shift_jis": "",
    "euc_jp": "",
    "gb18030": "",
    "euc_kr": "",
    "cp437": "éèäöüßçàáíóúñêôîâûëï",
}
LATIN, OTHER = "latin", ("cyrillic", "greek", "hiragana", "katakana", "cjk", "hangul")


@lru_cache(4096)
def script_of(c: str) -> str:
    name = unicodedata.name(c, "").lower()
    return next((s for s in (LATIN, *OTHER) if s in name), "mark" if unicodedata.category(c)[0] in "LM" else "sign")


def pair_likelihood(a: str, b: str, order: str) -> float:
    """The log-likelihood, roughly, that one character follows another in running text, given the letters that a code page is used for."""
    if b < "\x80":
        return 0.0 if a < "\x80" or a.isalpha() or b.isspace() else -1.0
    kind = script_of(b)
    if unicodedata.category(b) in ("Cc", "Cn", "Co", "Cs"):
        return -12.0
    if kind == "sign":
        return -1.5 if a.isspace() or a.isdigit() else -5.0
    score = -0.5 - 0.06 * order.index(b.lower()) if b.lower() in order else -1.0 if kind in ("hiragana", "katakana") else -2.0 if kind in ("cjk", "hangul") else -4.5
    if a.isalpha():
        mixed = script_of(a) != kind and not {script_of(a), kind} <= {"hiragana", "katakana", "cjk", "mark"}
        score -= 4.0 * mixed + 3.0 * (b.isupper() and a.islower()) + 2.0 * (b.islower() and a.isupper() and kind != LATIN and a < "\x80")
    return score


def likelihood(text: str, order: str, size: int) -> float:
    """The mean over the bytes beyond ASCII of what their characters are worth after the ones before them."""
    return sum(pair_likelihood(a, b, order) for a, b in zip(" " + text, text, strict=False) if a >= "\x80" or b >= "\x80") / max(1, size)


def wide_encoding(head: bytes) -> str | None:
    """UTF-16 without a mark: every other byte is nearly constant, and line breaks and commas are two bytes."""
    sample = head[: len(head) // 2 * 2]
    if len(sample) < 4:
        return None
    fit = {}
    for name, low in (("utf-16-le", 0), ("utf-16-be", 1)):
        signs = sum(sample[k + low] in b"\n\r,;\t \"0123456789" and sample[k + 1 - low] == 0 for k in range(0, len(sample), 2))
        fit[name] = signs / (len(sample) / 2)
    best = max(fit, key=fit.get)
    try:
        sample.decode(best)
    except UnicodeDecodeError:
        return None
    return best if fit[best] >= 0.02 and fit[best] > 4 * min(fit.values()) and b"\0" in sample else None


def encoding_of(head: bytes) -> str:
    """By byte order mark, else UTF-8 if it reads the sample, UTF-16 by its zero bytes, or the code page whose characters follow each other most likely."""
    if not head:
        raise ValueError("the file is empty")
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf-16"
    if wide := wide_encoding(head):
        return wide
    # a sample may end within a character
    cut = head if len(head) < SAMPLE_BYTES else head[:-4]
    try:
        cut.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        if len(head) >= SAMPLE_BYTES and e.start >= len(head) - 8:
            return "utf-8"
    best, most = "latin-1", float("-inf")
    beyond = sum(b >= 0x80 for b in cut)
    for name, order in CODE_PAGES.items():
        try:
            text = cut.decode(name)
        except UnicodeDecodeError as e:
            if len(head) < SAMPLE_BYTES or e.start < len(cut) - 4:
                continue
            text = cut[: e.start].decode(name)
        if (value := likelihood(text, order, beyond)) > most + 1e-9:
            best, most = name, value
    return best


def records(text: str, delimiter: str, limit: int) -> list[list[str]]:
    out = []
    try:
        for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter):
            if r:
                out.append(r)
            if len(out) == limit:
                break
    except csv.Error:
        pass
    return out


def delimiter_of(text: str) -> tuple[str, float]:
    """The delimiter whose records agree best on a width of at least two, wider first; else a comma."""
    best, top = None, 0.0
    for d in DELIMITERS:
        if widths := [len(r) for r in records(text, d, 200)]:
            width, n = Counter(widths).most_common(1)[0]
            value = n / len(widths) + min(width, 50) / 1000
            if width >= 2 and value > top:
                best, top = d, value
    return (best, min(top, 1.0)) if best else (",", 0.3)


def header_of(text: str, delimiter: str) -> int:
    """S3: the first of 20 records of the usual width whose cells are filled, distinct and mostly no numbers; else 0."""
    rows = records(text, delimiter, 200)
    if not rows:
        return 0
    width = Counter(map(len, rows)).most_common(1)[0][0]
    for k, r in enumerate(rows[:20]):
        cells = [c.strip() for c in r]
        if len(r) == width and all(cells) and len({c.lower() for c in cells}) == width and sum(bool(NUMERIC.match(c)) for c in cells) <= 0.3 * width:
            return k
    return 0


def names_of(cells: list[str]) -> tuple[list[str], list[str]]:
    """Trimmed names; empty ones unnamed, repeated ones numbered, whatever their case."""
    out, seen, notes = [], Counter(), []
    for c in cells:
        name = c.strip() or "unnamed"
        if k := seen[name.lower()]:
            notes.append(f"column {name} occurs again")
            out.append(f"{name}_{k}")
        else:
            out.append(name)
        seen[name.lower()] += 1
    return out, notes


def sniff(head: bytes, encoding: str | None = None, delimiter: str | None = None) -> Dialect:
    """The dialect of a file by its head; what is given is not guessed."""
    encoding = encoding or encoding_of(head)
    text = head.decode(encoding, errors="replace")
    delimiter, confidence = (delimiter, 1.0) if delimiter else delimiter_of(text)
    header = header_of(text, delimiter)
    columns, notes = names_of(records(text, delimiter, header + 1)[header])
    return Dialect(encoding, delimiter, confidence, header, columns, notes)
