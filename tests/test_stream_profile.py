"""The profile of a stream equals that of all its rows; stored results survive failures."""

from datetime import datetime

import fixtures
import pytest

from plumbline import shared
from plumbline.operators import profile as profiles
from plumbline.plans import assess as A
from plumbline.plans import store
from plumbline.plans.rules import default_pack
from plumbline.streaming import profiles as streamed

AS_OF = datetime(2024, 7, 1)


@pytest.fixture(scope="module")
def df(spark):
    rows, columns, _ = fixtures.dirty()
    keep = columns[:8]
    return spark.createDataFrame([(i + 2, *r[:8]) for i, r in enumerate(rows)], "__row__ long, " + ", ".join(f"`{c}` string" for c in keep)).cache()


def same(a, b):
    assert [c["column"] for c in a] == [c["column"] for c in b]
    for x, y in zip(a, b, strict=True):
        assert x.keys() == y.keys()
        for k in x:
            assert x[k] == (pytest.approx(y[k]) if isinstance(y[k], float) else y[k]), (x["column"], k)


def test_batches_in_any_split(spark, df, tmp_path):
    want = profiles.profile(df)
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "state", "cp"))
    df.where("__row__ % 3 = 0").repartition(2).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    streamed.profile_stream(stream, path, checkpoint).awaitTermination()
    same(streamed.profile_so_far(spark, path), profiles.profile(df.where("__row__ % 3 = 0")))
    streamed.compact(spark, path)
    # more rows come, and the stream is started again from its checkpoint
    df.where("__row__ % 3 <> 0").repartition(3).write.mode("append").parquet(source)
    streamed.profile_stream(stream, path, checkpoint).awaitTermination()
    same(streamed.profile_so_far(spark, path), want)
    streamed.compact(spark, path)
    assert len(shared.committed(spark, path)["parts"]) == 1
    same(streamed.profile_so_far(spark, path), want)


def test_replayed_batch_counts_once(spark, df, tmp_path):
    path = str(tmp_path / "state")
    with pytest.raises(ValueError, match="no batch"):
        streamed.profile_so_far(spark, path)
    streamed.keep_batch(df.where("__row__ < 200"), 0, path)
    streamed.keep_batch(df.where("__row__ < 200"), 0, path)
    same(streamed.profile_so_far(spark, path), profiles.profile(df.where("__row__ < 200")))


def test_batch_that_broke_off_is_not_read(spark, df, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    streamed.keep_batch(df.where("__row__ < 200"), 0, path)
    with monkeypatch.context() as m:
        m.setattr(streamed, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            streamed.keep_batch(df.where("__row__ >= 200"), 1, path)
    same(streamed.profile_so_far(spark, path), profiles.profile(df.where("__row__ < 200")))
    streamed.keep_batch(df.where("__row__ >= 200"), 1, path)
    same(streamed.profile_so_far(spark, path), profiles.profile(df))


def test_store_is_whole_or_as_before(spark, df, tmp_path, monkeypatch):
    few = [r for r in default_pack() if r.id in ("COM-NULL", "VAL-EMAIL")]
    a, path = A.assess(df, AS_OF, few), str(tmp_path / "run")
    with pytest.raises(ValueError, match="no assessment"):
        store.load_results(spark, path)
    store.save(a, path)
    b = A.assess(df.where("__row__ < 100"), AS_OF, few)
    with monkeypatch.context() as m:
        m.setattr(type(b), "results_frame", lambda self: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            store.save(b, path)
    assert store.load_meta(spark, path)["rows"] == a.rows and store.load_results(spark, path).count() == len(a.results)
    store.save(b, path)
    assert store.load_meta(spark, path)["rows"] == b.rows
    assert store.purge(spark, path) and shared.committed(spark, path) is None
