"""Rules: templates, the default pack, loading of packs, and binding to the columns of a profile."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from .. import config
from ..config import DIMENSIONS, SEVERITY_WEIGHTS

EMAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"
DATES = ["date", "datetime"]
NUMBERS = ["integer", "decimal"]


@dataclass(frozen=True)
class Rule:
    """A rule template, or, with ``column`` or record scope bound, a rule to evaluate."""

    id: str
    name: str
    dimension: str
    check: str
    severity: str = "medium"
    params: dict[str, Any] = field(default_factory=dict)
    applies_to: dict[str, Any] = field(default_factory=dict)
    message: str | None = None
    column: str | None = None
    template_id: str | None = None


def _rule(rule_id: str, check: str, severity: str, name: str, message: str | None = None, params: dict | None = None, **applies_to: Any) -> Rule:
    dimension = {"COM": "completeness", "VAL": "validity", "UNQ": "uniqueness", "CON": "consistency", "ACC": "accuracy", "TIM": "timeliness", "INT": "integrity"}[rule_id[:3]]
    return Rule(rule_id, name, dimension, check, severity, params or {}, applies_to, message)


def default_pack() -> list[Rule]:
    """The 34 rules that hold for any dataset.  Ids, checks, severities, parameters and patterns are fixed values."""
    return [
        _rule("COM-NULL", "not_null", "high", "Value present", "The field is empty"),
        _rule("COM-PLACEHOLDER", "not_placeholder", "medium", "Value is no placeholder", "The value only stands for a missing one"),
        _rule("COM-FILL", "fill_rate_above", "high", "Column filled well enough", params={"threshold": 0.95}),
        _rule("VAL-EMAIL", "regex_match", "high", "Mail address well formed", "Not the form of a mail address", {"pattern": EMAIL}, semantic_type="email"),
        _rule("VAL-PHONE", "valid_phone", "medium", "Phone number possible", "Not a possible phone number", {"region": "US"}, semantic_type="phone"),
        _rule("VAL-URL", "regex_match", "low", "URL well formed", "Not the form of a URL", {"pattern": r"^(https?://|www\.)[^\s]+$"}, semantic_type="url"),
        _rule("VAL-POSTCODE", "regex_match", "medium", "Postcode well formed", "Not the form of a postcode", {"pattern": r"^[A-Za-z0-9][A-Za-z0-9\s\-]{2,9}$"}, semantic_type="postcode"),
        _rule("VAL-CURRENCY", "regex_match", "medium", "Currency code well formed", "A currency code has three letters", {"pattern": r"^[A-Za-z]{3}$"}, semantic_type="currency_code"),
        _rule("VAL-DATE-PARSE", "parseable_date", "high", "Date readable", "Cannot be read as a date", semantic_type=DATES),
        _rule("VAL-DATE-RANGE", "date_in_plausible_range", "medium", "Date plausible", params={"min_year": 1900, "max_years_ahead": 10}, semantic_type=DATES),
        _rule("VAL-ENUM", "in_enum_domain", "medium", "Value in the column's domain", "Not one of the values that the column otherwise has", enum_only=True),
        _rule("VAL-TYPE", "type_conforms", "high", "Value of the column's type", inferred_type=[*NUMBERS, *DATES]),
        _rule("VAL-LENGTH", "length_within", "low", "Length plausible", inferred_type="string", min_fill_rate=0.1),
        _rule("VAL-NEGATIVE", "numeric_range", "medium", "Quantity not negative", "A quantity is not negative", {"allow_negative": False}, name_matches="quantity|qty|count|age|weight|height|duration"),
        _rule("UNQ-EXACT", "exact_record_duplicate", "high", "Record occurs once", scope="record"),
        _rule("UNQ-KEY", "candidate_key_duplicate", "high", "Key occurs once", params={"distinctness": 0.95}, scope="record"),
        _rule("UNQ-FUZZY", "fuzzy_duplicate", "medium", "No similar record", params={"threshold": 88, "max_block_size": None}, scope="record"),
        _rule("CON-PATTERN", "pattern_consistent", "medium", "Format as in the column", params={"coverage": 0.95}, min_fill_rate=0.1),
        _rule("CON-CASE", "consistent_casing", "low", "Casing as in the column", semantic_type=["person_name", "org_name", "city", "state", "country", "category"]),
        _rule("CON-WHITESPACE", "no_surrounding_whitespace", "low", "No white space around the value"),
        _rule("CON-DATEFMT", "single_date_format", "high", "One date format in the column", "The column mixes date formats", semantic_type=DATES),
        _rule("ACC-COUNTRY", "in_reference_list", "medium", "Country known", params={"list": "country"}, semantic_type="country"),
        _rule("ACC-CURRENCY", "in_reference_list", "medium", "Currency known", params={"list": "currency"}, semantic_type="currency_code"),
        _rule("ACC-EMAILDOM", "email_domain_plausible", "medium", "Mail domain plausible", "The mail domain looks like a misspelt common one", semantic_type="email"),
        _rule("ACC-DOB", "not_future_date", "high", "Birth not in the future", "A date of birth lies in the future", name_matches="birth|dob"),
        _rule("ACC-OUTLIER", "statistical_outlier", "low", "Value not an outlier", params={"threshold": 3.5}, inferred_type=NUMBERS),
        _rule("ACC-NEGATIVE", "non_negative", "medium", "No stray negative value", inferred_type=NUMBERS),
        _rule("TIM-STALE", "not_stale", "medium", "Updated lately", params={"days": 730}, semantic_type=DATES, name_matches="updated|modified|last|activity|contact|login|order|transaction"),
        _rule("TIM-FUTURE", "not_future_dated", "high", "Not dated in the future", semantic_type=DATES, name_matches="created|signup|joined|start|registered|opened"),
        _rule("TIM-RANGE", "within_expected_range", "low", "Date within the column's range", params={"margin_days": 3650}, semantic_type=DATES),
        _rule("INT-POSTCODE-COUNTRY", "postcode_matches_country", "medium", "Postcode fits the country", "The postcode's form is not the country's", semantic_type="postcode"),
        _rule("INT-ZIP-STATE", "zip_matches_state", "medium", "ZIP code fits the state", "The ZIP code is not of this state", semantic_type="postcode"),
        _rule("INT-CARDINALITY", "cardinality_holds", "high", "One value for each key", "Contradicts what the dataset otherwise says", scope="record"),
        _rule("INT-DEPENDENT-FIELD", "dependent_field_populated", "medium", "Partner field filled", "Empty although the field it goes with is filled", {"support": 0.90}, scope="record"),
    ]


def parse_pack(entries: list[dict[str, Any]], known: set[str] | None = None) -> list[Rule]:
    """Rules from plain records; ValueError for missing fields, repeated ids, and unknown dimensions, severities or checks."""
    out, seen = [], set()
    for e in entries:
        if missing := [k for k in ("id", "name", "dimension", "check") if not e.get(k)]:
            raise ValueError(f"rule {e.get('id', '?')}: {', '.join(missing)} missing")
        if e["id"] in seen:
            raise ValueError(f"rule {e['id']} occurs twice")
        seen.add(e["id"])
        if e["dimension"] in config.DEFERRED_DIMENSIONS:
            raise ValueError(f"rule {e['id']}: the dimension {e['dimension']} is deferred and not assessed yet (config.DEFERRED_DIMENSIONS)")
        if e["dimension"] not in DIMENSIONS:
            raise ValueError(f"rule {e['id']}: no dimension {e['dimension']}")
        if (severity := e.get("severity", "medium")) not in SEVERITY_WEIGHTS:
            raise ValueError(f"rule {e['id']}: no severity {severity}")
        if known is not None and e["check"] not in known:
            raise ValueError(f"rule {e['id']}: no check {e['check']}")
        out.append(Rule(e["id"], e["name"], e["dimension"], e["check"], severity, e.get("params") or {}, e.get("applies_to") or {}, e.get("message")))
    return out


def load_pack(path: str | None = None, known: set[str] | None = None) -> list[Rule]:
    """The default pack, or one from a JSON or YAML file with a list ``rules``."""
    if path is None:
        return default_pack()
    if not Path(path).exists():
        raise ValueError(f"there is no rule pack {path}")
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)
    entries = data.get("rules") if isinstance(data, dict) else None
    if not isinstance(entries, list) or not entries or not all(isinstance(e, dict) for e in entries):
        raise ValueError("a rule pack is a list of mappings under the name rules")
    return parse_pack(entries, known)


def _listed(x: Any) -> list:
    return x if isinstance(x, list) else [x]


def fits(rule: Rule, column: dict[str, Any]) -> bool:
    """Whether a template applies to a column of a profile."""
    a = rule.applies_to
    return (
        (not a.get("cde_only", True) or bool(column["is_cde"]))
        and ("semantic_type" not in a or column["semantic_type"] in _listed(a["semantic_type"]))
        and ("inferred_type" not in a or column["inferred_type"] in _listed(a["inferred_type"]))
        and ("name_matches" not in a or bool(re.search(a["name_matches"], column["column"], re.I)))
        and (not a.get("enum_only") or bool(column["enum_domain"]))
        and ("min_fill_rate" not in a or column["fill_rate"] >= a["min_fill_rate"])
    )


def bind(rules: list[Rule], profile: list[dict[str, Any]]) -> list[Rule]:
    """Rules bound to the columns they apply to, numbered in column order; record rules once."""
    out = []
    for rule in rules:
        if rule.applies_to.get("scope") == "record":
            out.append(replace(rule, template_id=rule.id))
            continue
        hits = [c["column"] for c in profile if fits(rule, c)]
        out += [replace(rule, id=f"{rule.id}-{k:02d}", name=f"{rule.name} ({c})", column=c, template_id=rule.id) for k, c in enumerate(hits, 1)]
    return out
