"""Repeated passages in texts of more than 16 MiB."""

import numpy as np

from plumbline.llm import suffixes


def test_repeated_run_above_16_mib(spark):
    text = np.random.default_rng(3).integers(97, 123, (1 << 24) + 5000, np.uint8).tobytes().decode()
    docs = spark.createDataFrame([(1, text), (2, "before " + text), (3, text[3000:9000])], "doc_id long, text string")
    rows = {r.doc_id: r for r in suffixes.without_repeats(docs).select("doc_id", "removed", "kept").collect()}
    assert rows[1].removed == [] and len(rows[1].kept) == len(text)
    assert [tuple(x) for x in rows[2].removed] == [(7, len(text) + 7)] and bytes(rows[2].kept) == b"before "
    assert [tuple(x) for x in rows[3].removed] == [(0, 6000)]


def test_anchors_do_not_depend_on_the_size_of_the_text(monkeypatch):
    """Also where 24 bits of hashes are equal within a passage."""
    real = suffixes.Rolling.of
    monkeypatch.setattr(suffixes.Rolling, "of", lambda self, a, b: real(self, a, b) & np.uint64((1 << 40) - 1))
    data = np.random.default_rng(4).integers(97, 123, (1 << 24) + 5000, np.uint8).tobytes()
    runs = suffixes.passage_runs(np.frombuffer(data, np.uint8), np.array([len(data)]), 100, 32)
    first, gram = runs["first"], runs["h"]
    for at in (0, (1 << 23) - 1500, (1 << 24) - 500):
        few = suffixes.passage_runs(np.frombuffer(data[at : at + 3000], np.uint8), np.array([3000]), 100, 32)
        passages = np.arange(2900)
        got, want = gram[np.searchsorted(first, at + passages, "right") - 1], few["h"][np.searchsorted(few["first"], passages, "right") - 1]
        assert (got == want).all()
