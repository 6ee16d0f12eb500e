"""Codes of names that descriptions of the method give."""

from datetime import datetime

import pytest

from plumbline.functions.phonetic import codes, phonetic_codes
from plumbline.operators import checks, records

KNOWN = {
    "aubrey": "APR", "richard": "RXRT RKRT", "Jose": "HS", "cambrillo": "KMPRL KMPR", "otto": "AT", "maurice": "MRS", "auto": "AT", "maisey": "MS", "catherine": "K0RN KTRN", "geoff": "JF KF",
    "Chile": "XL", "steven": "STFN", "zhang": "JNK", "bob": "PP", "ray": "R", "Tux": "TKS", "bryan": "PRN", "bryce": "PRS", "Dallas": "TLS", "Schwein": "XN XFN", "dave": "TF", "eric": "ARK",
    "randy": "RNT", "Through": "0R TR", "Nowhere": "NR", "heidi": "HT", "Arnow": "ARN ARNF", "Thumb": "0M TM", "Smith": "SM0 XMT", "Schmidt": "XMT SMT", "Michael": "MKL MXL", "Philip": "FLP",
    "Wright": "RT", "knight": "NT", "Jones": "JNS ANS", "Xavier": "SF SFR", "Catherine": "K0RN KTRN", "Kathryn": "K0RN KTRN",
}


@pytest.mark.parametrize("name", KNOWN)
def test_known(name):
    assert " ".join(dict.fromkeys(codes(name))) == KNOWN[name]


def test_column(spark):
    got = spark.createDataFrame([("Smith",), ("Schmidt",), (None,), ("123",), ("",)], "x string").select(phonetic_codes("x").alias("c")).collect()
    assert [r.c for r in got] == [["SM0", "XMT"], ["XMT", "SMT"], [], [], []]


def test_blocks_meet_on_either_code(spark):
    """Names that share an alternate code only are compared, and found where the rest of the record agrees."""
    rows = [(1, "Smith Anna", "anna.smith@mail.com"), (2, "Smitt Anna", "a.smith@mail.com"), (3, "Bob Ray", "bob@mail.com"), (4, None, "x@mail.com")]
    df = spark.createDataFrame(rows, "__row__ long, full_name string, email string")
    profile = [{"column": "full_name", "semantic_type": "person_name", "is_cde": True}, {"column": "email", "semantic_type": "email", "is_cde": True}]
    context = checks.Context(df, profile, datetime(2024, 7, 1))
    keys = {r["row"]: set(r["keys"]) for r in records.fuzzy_keys(context, phonetic=True).collect()}
    assert keys[1] & keys[2] == {"n:smi:XMTN"} and "n:smi:SM0N" in keys[1] and "n:smi:SMTN" in keys[2]
    assert keys[4] == {"e:x"}
    plain = {r["row"]: set(r["keys"]) for r in records.fuzzy_keys(context).collect()}
    assert not any(k.startswith("n:smi:") for k in plain[1])
