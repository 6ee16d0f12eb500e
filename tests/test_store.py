"""Stored assessments and streams agree with batch runs."""

from datetime import datetime

import fixtures
import pytest

from plumbline.plans import assess as A
from plumbline.plans import registry, store
from plumbline.plans.rules import default_pack
from plumbline.streaming import counters

AS_OF = datetime(2024, 7, 1)
FEW = [r for r in default_pack() if r.id in ("COM-NULL", "VAL-EMAIL", "UNQ-KEY", "CON-WHITESPACE")]


@pytest.fixture(scope="module")
def df(spark):
    rows, columns, _ = fixtures.dirty()
    return spark.createDataFrame([(i + 2, *r) for i, r in enumerate(rows)], "__row__ long, " + ", ".join(f"`{c}` string" for c in columns)).cache()


def test_store(spark, df, tmp_path):
    a = A.assess(df, AS_OF, FEW)
    path = str(tmp_path / "run")
    store.save(a, path)
    store.save(a, path)
    profile = store.load_profile(spark, path)
    b = A.assess(df, AS_OF, FEW, profile=profile)
    assert (b.results, b.scores) == (a.results, a.scores)
    assert store.load_meta(spark, path)["overall"] == a.overall
    assert store.load_results(spark, path).count() == len(a.results)
    rule = next(r["rule_id"] for r in a.results if r["template_id"] == "VAL-EMAIL")
    assert store.load_examples(spark, path, "validity", rule).count() == fixtures.dirty()[2]["mail form"]
    page = store.render(a)
    assert "VAL-EMAIL" in page and "What this means" in page and "Not assessed" in page
    at_once = A.assess(df, AS_OF, FEW, profile=profile, with_examples=True)
    assert at_once.results == a.results and at_once.examples.exceptAll(a.examples).count() == a.examples.exceptAll(at_once.examples).count() == 0
    store.save_data(df, f"{path}/data")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{path}/data").count() == 480 + fixtures.AGAIN
    assert store.purge(spark, path)


def test_stream(spark, df, tmp_path):
    a = A.assess(df, AS_OF, FEW)
    source = str(tmp_path / "in")
    df.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    counters.count_stream(stream, a.profile, AS_OF, str(tmp_path / "out"), str(tmp_path / "cp"), FEW).awaitTermination()
    got = {r.rule_id: (r.evaluated, r.failed) for r in counters.totals(spark, str(tmp_path / "out")).collect()}
    want = {r["rule_id"]: (r["evaluated"], r["failed"]) for r in a.results if r["template_id"] != "UNQ-KEY"}
    assert {k: got[k] for k in want} == want


def test_registry(spark):
    rows = [(1, None, None, "completed", 5), (2, 7, 3, "processing", 6), (3, 8, 3, "completed", 7), (4, 8, 4, "completed", 8)]
    runs = spark.createDataFrame(rows, "run_id long, owner_id long, assessment_id long, status string, created long").selectExpr("*", "80.0 overall")
    assert {r.assessment_id: r.status for r in registry.assessment_status(runs).collect()} == {3: "processing", 4: "completed"}
    assert [r.run_id for r in registry.list_runs(runs).collect()] == [1]
    assert registry.delete_cascade(runs, 3).count() == 2 and registry.expired(runs, 7).count() == 2
    assert registry.claimed(runs, 9).where("owner_id = 9").count() == 1


def test_catalogue(spark):
    from plumbline.sources import catalogue

    cols = "name string, label string, queryable boolean, retrieveable boolean, deprecatedAndHidden boolean, customSetting boolean, layoutable boolean, custom boolean"
    rows = [("Account", "account", True, None, None, None, True, None), ("Zed__c", "", True, True, False, False, True, True), ("AccountShare", "x", True, True, False, False, True, False), ("Hidden", "h", True, True, True, False, True, False), ("No", "n", False, True, False, False, True, False)]
    got = catalogue.objects(spark.createDataFrame(rows, cols), spark.createDataFrame([("Account", 5)], "name string, n long")).collect()
    assert [(r.name, r.label, r.record_count, r.hidden_count) for r in got] == [("Account", "account", 5, 2), ("Zed__c", "Zed__c", None, 2)]
    schema = "object string, position int, name string, label string, type string, custom boolean, nillable boolean, createable boolean, defaultedOnCreate boolean, deprecatedAndHidden boolean, referenceTo array<string>, length int, picklist array<struct<value:string,active:boolean>>"
    data = [("A", 0, "Name", None, "string", None, False, True, None, None, None, 80, None), ("A", 1, "Id", "Key", "id", None, False, False, True, None, None, 18, None), ("A", 2, "Addr", None, "address", None, True, True, None, None, None, 0, None), ("A", 3, "Kind", None, "picklist", None, True, True, None, None, None, 0, [("a", True), ("b", False)])]
    out = [r.asDict() for r in catalogue.fields(spark.createDataFrame(data, schema)).orderBy("position").collect()]
    assert [(r["name"], r["required"], r["picklist"]) for r in out] == [("Id", False, None), ("Name", True, None), ("Kind", False, ["a"])]
    assert catalogue.schema_of(out).fieldNames() == ["Id", "Name", "Kind"]


def test_serve(spark, df):
    from plumbline.plans import serve

    small = {"a": df.select("__row__", "contact_email", "home_city"), "b": df.select("__row__", "mobile_phone", "home_city").limit(60)}
    parked = serve.profile_all(small)
    assert serve.profile_view(spark, parked["a"]).where("semantic_type = 'email'").count() == 1
    with pytest.raises(ValueError):
        serve.confirm_all(small, parked, {"a": ["nope"]}, AS_OF)
    runs, both = serve.confirm_all(small, parked, {"a": ["contact_email"]}, AS_OF)
    assert set(runs) == {"a", "b"} and both["overall"] is not None
    assert sum(c["is_cde"] for c in runs["a"].profile) == 1
    names = spark.createDataFrame([("Account", "x"), ("Other", None)], "name string, label string")
    assert [r.name for r in serve.search(names, " ACC", "name", "label").collect()] == ["Account"]
    view = serve.run_view(spark.sql("select 1 run_id, 'failed' status, 1 records, 1 columns, 1 cdes, 2.0 overall, 'no' error")).first()
    assert view.overall is None and view.error == "no"
    assert serve.in_group(spark, "g", lambda: spark.range(3).count()) == 3
