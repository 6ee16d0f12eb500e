"""BPE encoding and decoding with a public vocabulary.

Encoding keeps the symbols of a word in a doubly linked list and the possible
merges in a priority queue by rank; queue entries whose symbols have changed
meanwhile are skipped.  Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED, and_fields, tidy

#: Distinct chunks in each of the two generations that a worker remembers: those met lately, and those met before them.
CACHE_CHUNKS = 250_000
#: Rows of an Arrow batch that are encoded at a time.
SLICE = 500
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a word-end BPE tokenizer file (JSON)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in merges]
        self.ranks = {a << 32 | b: r for r, (a, b, _) in enumerate(self.merges)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.words = {i: w for w, i in [*self.ids.items(), *self.special.items()]}
        pattern = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}"))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.odd_space = regex.compile("[\x1c-\x1f]")
        self.space = regex.compile(f"[{SPACE}]+")
        alphabet = byte_alphabet()
        self.inner, self.final = [self.ids.get(c) for c in alphabet], [self.ids.get(c + self.end) for c in alphabet]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def word(self, piece: str) -> list[int]:
        """Token ids of one pre-token."""
        data, inner, ranks, merges = piece.encode(), self.inner, self.ranks, self.merges
        sym = [inner[b] for b in data]
        sym[-1] = self.final[data[-1]]
        if None in sym:
            sym = [s for s in sym if s is not None]
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [r << 32 | i for i in range(n - 1) if (r := ranks.get(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            i = top & 0xFFFFFFFF
            a, b, made = merges[top >> 32]
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # stale: a merge has taken one of the two
            sym[i], sym[j] = made, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := ranks.get(made << 32 | sym[k])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            h = left[i]
            if h >= 0 and (r := ranks.get(sym[h] << 32 | made)) is not None:
                heapq.heappush(queue, r << 32 | h)
        return [s for s in sym if s >= 0]

    def chunk(self, text: str) -> bytes:
        """Ids (little-endian unsigned 32 bit) of a chunk without white space; often met chunks pass from the old generation to the young one."""
        made = self.old.get(text)
        if made is None:
            ids = [i for piece in self.pieces.findall(text) for i in self.word(piece)]
            made = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.young) >= CACHE_CHUNKS:
            self.old, self.young = self.young, {}
        self.young[text] = made
        return made

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        ids = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if (special := self.special.get(part)) is not None:
                ids.append(struct.pack("<I", special))
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            chunks = self.space.split(part) if self.odd_space.search(part) else part.split()
            chunk = self.chunk
            for c in chunks:
                if c:
                    made = self.young.get(c)
                    ids.append(chunk(c) if made is None else made)
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """The text of ids: vocabulary strings, a space between them."""
        return " ".join(map(self.words.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


def encoded(batches: Iterator[pa.RecordBatch], bpe: WordBpe, text: str) -> Iterator[pa.RecordBatch]:
    """Batches with ``ids`` and ``decoded``, SLICE rows at a time; what the encoder remembers goes with the task, as workers outlive it."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            got = [bpe.encode(t.as_py() or "") for t in batch.column(text)]
            ends = np.cumsum([0, *(len(a) // 4 for a in got)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(map(bpe.decode, got), pa.string())], [*batch.schema.names, "ids", "decoded"])
    bpe.young, bpe.old = {}, {}


@lru_cache(1)
def encoder(spec: str) -> WordBpe:
    """The encoder of a worker: what it remembers serves all its tasks."""
    REMEMBERED[__name__] = encoder.cache_clear
    return WordBpe(spec)


def vocabulary(df: DataFrame, tokenizer_path: str):
    """The tokenizer file (of fixed size), sent to all tasks."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(df: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array<int>) and ``decoded`` (string) for its text column.

    Null texts count as empty and give no ids and an empty decoded text; texts
    are encoded whole, whatever their length.  Input columns named ``ids`` or
    ``decoded`` give way to the new ones; all others are kept as they are.
    Repeated rows and an empty table need nothing special.
    """
    spec = vocabulary(df, tokenizer_path)
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("ids", "decoded")])
    return kept.mapInArrow(tidy(lambda batches: encoded(batches, encoder(spec.value), text)), and_fields(kept.schema, "ids array<int>, decoded string"))


def digests(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens and SHA-256 of its ids and of its decoded text, taken from what ``encoded`` gives."""
    spec = vocabulary(df, tokenizer_path)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encoded(batches, encoder(spec.value), "text"):
            ids = batch.column("ids")
            flat, ends = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
            n = np.diff(ends).astype(np.int64)
            a = [hashlib.sha256(flat[s:e].tobytes()).hexdigest() for s, e in zip(ends[:-1], ends[1:], strict=True)]
            b = [hashlib.sha256(t.as_py().encode()).hexdigest() for t in batch.column("decoded")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
