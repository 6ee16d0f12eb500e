"""Golden counts of seeded defects, and properties of whole assessments."""

import json
from datetime import datetime

import fixtures
import pytest

from plumbline.operators import checks, records
from plumbline.operators import profile as profiles
from plumbline.plans import assess as A
from plumbline.plans import rules as R

AS_OF = datetime(2024, 7, 1)


def frame(spark, made, parts=2):
    rows, columns = made
    schema = "__row__ long, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame([(i + 2, *r) for i, r in enumerate(rows)], schema).repartition(parts)


@pytest.fixture(scope="module")
def dirty(spark):
    return A.assess(frame(spark, fixtures.dirty()[:2]).cache(), AS_OF)


#: rule, column, and the kinds of defects it has to count.
GOLDEN = [
    ("COM-NULL", "contact_email", ["missing mail"]), ("COM-PLACEHOLDER", "contact_email", ["stand-in mail"]), ("VAL-EMAIL", "contact_email", ["mail form"]),
    ("VAL-PHONE", "mobile_phone", ["short phone"]), ("VAL-DATE-PARSE", "joined_date", ["unreadable date"]), ("VAL-ENUM", "member_status", ["rare tier"]),
    ("UNQ-EXACT", None, ["again"]), ("UNQ-KEY", None, ["again"]), ("UNQ-FUZZY", None, ["again"]), ("CON-WHITESPACE", "contact_name", ["spaces"]),
    ("CON-CASE", "home_city", ["capitals"]), ("CON-DATEFMT", "joined_date", ["unreadable date"]), ("ACC-COUNTRY", "country", ["no country"]),
    ("ACC-CURRENCY", "currency_code", ["no currency"]), ("ACC-EMAILDOM", "contact_email", ["misspelt domain"]), ("ACC-OUTLIER", "paid_amount", ["far amount"]),
    ("TIM-FUTURE", "joined_date", ["date to come"]), ("TIM-STALE", "last_activity_date", ["long silent"]),
]


@pytest.mark.parametrize(("rule", "column", "kinds"), GOLDEN)
def test_golden(dirty, rule, column, kinds):
    manifest = fixtures.dirty()[2]
    assert [r["failed"] for r in dirty.results if r["template_id"] == rule and r["column"] == column] == [sum(manifest[k] for k in kinds)]


def test_no_errors_and_cdes(dirty):
    assert dirty.errors == {}
    by = {c["column"]: c["is_cde"] for c in dirty.profile}
    assert not by["batch_no"] and not by["modified_by"] and by["member_id"] and by["country"] and 0.25 <= sum(by.values()) / len(by) <= 0.85


def test_clean_scores_high_and_resume_equals(spark, dirty):
    df = frame(spark, fixtures.clean()).cache()
    a = A.assess(df, AS_OF)
    assert a.overall >= 90 and a.overall > dirty.overall
    b = A.assess(df, AS_OF, profile=[dict(c) for c in a.profile])
    assert (b.scores, b.overall, b.results) == (a.scores, a.overall, a.results)
    c = A.assess(df.repartition(7), AS_OF)
    assert c.results == a.results
    pooled = A.pool({"a": a, "b": b})
    assert pooled["scores"] == a.scores
    with pytest.raises(ValueError):
        A.assess(df, AS_OF, cdes=["nope"])


def test_examples_and_report(dirty):
    rule = next(r for r in dirty.results if r["template_id"] == "COM-NULL" and r["column"] == "contact_email")
    total, rows = dirty.rule_examples(rule["rule_id"])
    got = rows.collect()
    assert total == len(got) == fixtures.dirty()[2]["missing mail"] and got[0].value == "(null)" and [r.row for r in got] == sorted(r.row for r in got)
    report = A.report_context(dirty)
    assert report["rules"] and all(len(r["examples"]) <= 10 for r in report["rules"])


def test_single_column_and_no_dates(spark):
    one = A.assess(spark.createDataFrame([(i, f"name {i % 9}") for i in range(50)], "__row__ long, name string"), AS_OF)
    assert one.scores["integrity"] is None and one.scores["timeliness"] is None and one.overall > 0


def test_empty_table(spark):
    a = A.assess(spark.createDataFrame([], "__row__ long, name string, email string"), AS_OF)
    assert a.results == [] and a.overall is None


def test_rule_packs():
    assert len(R.default_pack()) == 34
    known = {*checks.CELL_CHECKS, *records.RECORD_CHECKS}
    assert {r.check for r in R.default_pack()} <= known and len(checks.CELL_CHECKS) == 25
    good = {"id": "A", "name": "a", "dimension": "validity", "check": "not_null"}
    assert R.parse_pack([good], known)[0].severity == "medium"
    for bad in ([good, good], [{**good, "dimension": "x"}], [{**good, "severity": "x"}], [{**good, "check": "x"}], [{"id": "A"}]):
        with pytest.raises(ValueError):
            R.parse_pack(bad, known)
    with pytest.raises(ValueError):
        checks.cell_check("not_null")(lambda *a: None)


def test_functional_dependency(spark):
    def rows(wrong):
        return [(i, f"P-{i % 6}", wrong.get(i, f"part {i % 6}"), f"1000{i % 6}", f"Town {i % 6}") for i in range(120)]

    schema = "__row__ long, product_code string, product_name string, postcode string, city string"
    only = [r for r in R.default_pack() if r.id == "INT-CARDINALITY"]
    a = A.assess(spark.createDataFrame(rows({7: "part 2", 33: "part 0"}), schema), AS_OF, only)
    assert [r["failed"] for r in a.results] == [2]
    why = [r.reason for r in a.rule_examples("INT-CARDINALITY")[1].collect()]
    assert all("product_name" in w and "part" in w for w in why)
    b = A.assess(spark.createDataFrame(rows({}), schema), AS_OF, only)
    assert [r["failed"] for r in b.results] == [0] and b.scores["integrity"] == 100.0


def test_cross_dataset(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "zz")], "__row__ long, parent_id string")
    parent = spark.createDataFrame([("A",), ("b",)], "key string")
    context = checks.Context(child, profiles.profile(child), AS_OF, {"parents": parent})
    rule = R.Rule("X", "x", "integrity", "foreign_key_resolves", params={"parent_dataset": "parents", "key": "parent_id", "parent_key": "key"})
    found = records.foreign_key_resolves(rule, context)
    assert (found.evaluated, found.failed) == (3, 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.component for r in records.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[300] == 100 and {got[k] for k in range(500, 560)} == {500}


def test_registered_and_files(tmp_path):

    from plumbline.operators import registered

    assert registered.kind_of("not_null") == "cell" and registered.kind_of("fuzzy_duplicate") == "record" and not registered.is_registered("x")
    assert len(registered.checked_pack()) == 34
    path = tmp_path / "pack.json"
    path.write_text(json.dumps({"rules": [{"id": "A", "name": "a", "dimension": "validity", "check": "regex_match", "params": {"pattern": "^a"}, "applies_to": {"name_matches": "code"}}]}))
    rules = registered.checked_pack(str(path))
    profile = [{"column": c, "is_cde": True, "semantic_type": "identifier", "inferred_type": "string", "enum_domain": [], "fill_rate": 1.0} for c in ("code_a", "other", "CODE_B")]
    assert [(r.id, r.column) for r in R.bind(rules, profile)] == [("A-01", "code_a"), ("A-02", "CODE_B")]
    path.write_text(json.dumps({"rules": [{"id": "A", "name": "a", "dimension": "validity", "check": "nope"}]}))
    with pytest.raises(ValueError):
        registered.checked_pack(str(path))


def test_one_faulty_rule_does_not_stop_others(spark):
    df = spark.createDataFrame([(i, f"c{i}@mail.com") for i in range(30)], "__row__ long, email string")
    broken = R.Rule("BAD", "x", "validity", "regex_match", params={}, column=None)
    fine = R.Rule("OK", "x", "completeness", "not_null")
    a = A.assess(df, AS_OF, [broken, fine], cdes=["email"])
    assert list(a.errors) == ["BAD-01"] and [r["rule_id"] for r in a.results] == ["OK-01"]


def test_refused_packs(tmp_path, monkeypatch):
    path = tmp_path / "pack.json"
    for text in ('{"rules": []}', "[]", '{"rules": ["x"]}'):
        path.write_text(text)
        with pytest.raises(ValueError, match="list of mappings"):
            R.load_pack(str(path))
    with pytest.raises(ValueError, match="no rule pack"):
        R.load_pack(str(tmp_path / "none.json"))
    monkeypatch.setattr(R.config, "DEFERRED_DIMENSIONS", ("lineage",))
    path.write_text(json.dumps({"rules": [{"id": "A", "name": "a", "dimension": "lineage", "check": "not_null"}]}))
    with pytest.raises(ValueError, match="deferred"):
        R.load_pack(str(path))
