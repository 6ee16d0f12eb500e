"""Where records begin in ranges of bytes of a delimited file, by speculation on quotes.

A line break may stand inside quotes, so a range of bytes alone does not tell
whether it begins in a record or between two.  Each range is therefore scanned
for both cases at once, side by side with all others: how many records begin
in it, where its first whole record begins, and in which case it ends.  Going
through the ranges in order then only follows these answers.
"""

from __future__ import annotations

import csv
import io
import sys
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

MESSAGES = 20
#: Encodings in which the byte 10 is a line break wherever it stands; files in others are one range.
SPLITTABLE = ("ascii", "utf-8", "utf-8-sig", "latin-1", "iso8859", "cp125", "cp437", "cp85", "cp86", "koi8", "shift_jis", "cp932", "euc", "gb2312", "gbk", "big5", "mac")


def splittable(encoding: str) -> bool:
    return encoding.lower().replace("_", "-").startswith(tuple(s.replace("_", "-") for s in SPLITTABLE))


def opened(path: str):
    """A file for reading bytes with seek: a path of a file system that all share, or an address that pyarrow knows."""
    if path.startswith("file:"):
        path = urlparse(path).path
    if "://" not in path:
        return open(path, "rb")  # noqa: SIM115
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return io.BufferedReader(system.open_input_file(name), 1 << 20)


def size_of(path: str) -> int:
    with opened(path) as f:
        return f.seek(0, io.SEEK_END)


class Lines:
    """The lines that begin in [start, stop) of a file, decoded; counts bytes, and tells when it was asked for more."""

    def __init__(self, file, start: int, stop: int, encoding: str):
        self.file, self.stop, self.encoding = file, stop, "utf-8" if encoding == "utf-8-sig" else encoding
        self.parts: deque[str] = deque()
        self.over = False
        # other encodings: the whole file, in which places are counted in characters, fewer than its bytes
        self.text = None if splittable(encoding) else io.TextIOWrapper(file, encoding, errors="replace", newline="")
        file.seek(max(0, start - 1))
        if self.text:
            self.at = 0
        elif start:
            self.at = start - 1 + len(file.readline())
        else:
            self.at = 3 if encoding == "utf-8-sig" and file.read(3) == b"\xef\xbb\xbf" else 0
            file.seek(self.at)

    def __iter__(self) -> Lines:
        return self

    def __next__(self) -> str:
        if not self.parts:
            data = (self.text or self.file).readline() if self.at < self.stop else b""
            if not data:
                self.over = True
                raise StopIteration
            self.at += len(data)
            text = data if self.text else data.decode(self.encoding, errors="replace")
            self.parts.extend(io.StringIO(text, newline="") if "\r" in text[:-2] else (text,))
        return self.parts.popleft()

    def between(self) -> bool:
        """Whether nothing of a line is held back."""
        return not self.parts


def reader(lines: Iterator[str], delimiter: str):
    csv.field_size_limit(sys.maxsize)
    return csv.reader(lines, delimiter=delimiter)


@dataclass
class Case:
    """What a range holds if it begins between records, or (skipping the rest of one) within: where its first record begins,
    records, those wider than the header with the first of them, and where a record begins that goes on beyond the range."""

    begin: int
    records: int = 0
    wide: int = 0
    first_wide: list[list[int]] = field(default_factory=list)
    open_at: int = -1

    def take(self, width: int, most: int) -> None:
        if width > most:
            self.wide += 1
            if len(self.first_wide) < MESSAGES:
                self.first_wide.append([self.records, width])
        self.records += 1


def scan_between(file, start: int, stop: int, encoding: str, delimiter: str, width: int, meet: int = -1) -> tuple[Case, Case | None]:
    """The case of a range that begins between records, and what was counted when the byte ``meet`` was passed between records."""
    lines = Lines(file, start, stop, encoding)
    case, at_meeting = Case(lines.at), None
    rows = reader(lines, delimiter)
    while True:
        at = lines.at
        if at == meet and lines.between():
            at_meeting = Case(at, case.records, case.wide)
        cells = next(rows, None)
        if cells is None:
            return case, at_meeting
        if lines.over:
            case.open_at = at
            case.records += 1
            return case, at_meeting
        if cells:
            case.take(len(cells), width)


def end_of_open(file, start: int, stop: int, encoding: str, delimiter: str) -> int:
    """The byte after the record in which a range begins, or -1 if that goes on beyond the range."""
    lines = Lines(file, start, stop, encoding)
    for line in lines:
        if '"' in line:
            whole = reader(_chained('"' + line, lines), delimiter)
            next(whole, None)
            return -1 if lines.over else lines.at
    return -1


def _chained(first: str, rest: Iterator[str]) -> Iterator[str]:
    yield first
    yield from rest


def scan(path: str, start: int, stop: int, encoding: str, delimiter: str, width: int) -> tuple[Case, Case | None]:
    """Both cases of a range; the second is None where a record that is open at its beginning is still open at its end."""
    with opened(path) as file:
        end = end_of_open(file, start, stop, encoding, delimiter) if start else -1
        between, met = scan_between(file, start, stop, encoding, delimiter, width, end)
        if end < 0:
            return between, None
        if met is None:
            # the two never meet: the rest is scanned again from there
            within = scan_between(file, end, stop, encoding, delimiter, width)[0] if end < stop else Case(end)
            return between, within
        later = [[i - met.records, w] for i, w in between.first_wide if i >= met.records]
        within = Case(end, between.records - met.records, between.wide - met.wide, later, between.open_at if between.open_at >= end else -1)
        if within.wide > len(later) and len(later) < MESSAGES:
            within = scan_between(file, end, stop, encoding, delimiter, width)[0]
        return between, within


def records(path: str, begin: int, stop: int, encoding: str, delimiter: str) -> Iterator[list[str]]:
    """The records that begin in [begin, stop), the last one read to its end beyond."""
    with opened(path) as file:
        lines = Lines(file, begin, sys.maxsize, encoding) if begin == 0 else _at(file, begin, encoding)
        rows = reader(lines, delimiter)
        while lines.at < stop or not lines.between():
            cells = next(rows, None)
            if cells is None:
                return
            if cells:
                yield cells


def _at(file, begin: int, encoding: str) -> Lines:
    """Lines from a byte that is known to begin one."""
    lines = Lines(file, 0, sys.maxsize, encoding)
    file.seek(begin)
    lines.at = begin
    return lines


def follow(ranges: list[tuple[int, Case, Case | None]], open_width: Callable[[int], int], width: int) -> tuple[list[tuple[int, int, int]], int, int, list[list[int]]]:
    """Goes through the ranges (stop, if between, if within) of a file in order.

    Returns (begin, stop, records before) of those in which records begin, the number of
    records, of too wide ones, and the first of these with their widths.  ``open_width``
    tells the width of a record that begins at a byte and leaves its range.
    """
    parts, total, wide, first, within = [], 0, 0, [], False
    for stop, between, other in ranges:
        case = other if within else between
        if case is None:
            continue
        if case.records:
            parts.append((case.begin, stop, total))
        first += [[total + i, w] for i, w in case.first_wide]
        wide += case.wide
        total += case.records
        within = case.open_at >= 0
        if within and (n := open_width(case.open_at)) > width:
            first.append([total - 1, n])
            wide += 1
    return parts, total, wide, first[:MESSAGES]
