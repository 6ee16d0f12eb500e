"""Phonetic codes of names, a first and an alternate one, by a table of rules read from left to right.

At each place of the capital letters the first rule of the letter there whose
pattern fits (patterns may look back and ahead) adds its sounds to both codes and
takes its letters.  ``0`` is the th of thin, ``X`` the sh of shin; vowels count at the start only.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

V = "AEIOUY"

#: letter: rules (pattern at the place, sound of the first code, sound of the alternate or None for the same, letters taken).
RULES: dict[str, list[tuple[str, str, str | None, int]]] = {
    **{v: [(rf"^{v}", "A", None, 1), (v, "", None, 1)] for v in V},
    "B": [("BB?", "P", None, 0)],
    "C": [
        (rf"(?<=.[^{V}]A)CH(?!I)(?=[^E])", "K", None, 2), (r"^CAESAR", "S", None, 2), (r"CHIA", "K", None, 2), (r"(?<=.)CHAE", "K", "X", 2),
        (r"^CH(?:ARAC|ARIS|OR(?!E)|YM|IA|EM)", "K", None, 2), (r"(?<=OR)CHE(?=S)|(?<=AR)CHIT|(?<=OR)CHID", "K", None, 2), (r"CH[TS]", "K", None, 2),
        (r"(?:^|(?<=[AOUE]))CH(?=[LRNMBHFVW ]|$)", "K", None, 2), (r"^CH", "X", None, 2), (r"(?<=^M)CH", "K", None, 2), (r"CH", "X", "K", 2),
        (r"CZ(?<!WICZ)", "S", "X", 2), (r"CIA", "X", None, 3), (r"(?<=^A)CC(?=[IEH])|(?<=U)CC(?=EE|ES)", "KS", None, 3), (r"(?<!^M)CC(?=[IEH](?!U))", "X", None, 3),
        (r"CC|C[KGQ]", "K", None, 2), (r"CI[OEA]", "S", "X", 2), (r"C[IEY]", "S", None, 2), (r"C(?=C(?![EI])|K|Q)", "K", None, 2), (r"C", "K", None, 1),
    ],
    "D": [(r"DG[IEY]", "J", None, 3), (r"DG", "TK", None, 2), (r"D[DT]", "T", None, 2), (r"D", "T", None, 1)],
    "F": [("FF?", "F", None, 0)],
    "G": [
        (rf"(?<=[^{V}])GH", "K", None, 2), (r"^GHI", "J", None, 2), (r"^GH", "K", None, 2), (r"(?<=[BHD].)GH|(?<=[BHD]..)GH|(?<=[BH]...)GH", "", None, 2),
        (r"(?<=[CGLRT].U)GH", "F", None, 2), (r"(?<=[^I])GH", "K", None, 2), (r"GH", "", None, 2), (rf"(?<=^[{V}])GN", "KN", "N", 2), (r"GN(?!EY|Y)", "N", "KN", 2), (r"GN", "KN", None, 2),
        (r"GLI", "KL", "L", 2), (r"^G(?:Y|ES|EP|EB|EL|EY|IB|IL|IN|IE|EI|ER)", "K", "J", 2), (r"(?<![EI])(?<!^DAN)(?<!^RAN)(?<!^MAN)(?:GER|(?<![RO])GY)", "K", "J", 2),
        (r"GET", "K", None, 2), (r"GIER$", "J", None, 2), (r"G[EIY]|(?<=[AO])GGI", "J", "K", 2), (r"GG?", "K", None, 0),
    ],
    "H": [(rf"(?:^|(?<=[{V}]))H(?=[{V}])", "H", None, 2), (r"H", "", None, 1)],
    "J": [(r"^JOSE$|^JOSE(?= )|(?<=^SAN )J", "H", None, 1), (r"^JOSE", "J", "H", 1), (r"^J", "J", "A", 1), (rf"(?<=[{V}])J(?=[AO])", "J", "H", 1), (r"J$", "J", "", 1), (r"(?<![SKL])J(?![LTKSNMBZJE])", "J", None, 1), (r"(?<![SKL])J(?=E.)", "", None, 1), (r"JJ", "J", None, 2), (r"J", "", None, 1)],
    "K": [("KK?", "K", None, 0)],
    "L": [(r"LL(?=O$|A$)(?<=ILL)|(?<=A)LL(?=E$)|(?<=I)LL(?=[OA]S$)", "L", "", 2), (r"LL?", "L", None, 0)],
    "M": [(r"(?<=U)MB(?:$|(?=ER))", "M", None, 2), (r"MM?", "M", None, 0)],
    "N": [("NN?", "N", None, 0)],
    "P": [(r"PH", "F", None, 2), (r"P[PB]", "P", None, 2), (r"P", "P", None, 1)],
    "Q": [("QQ?", "K", None, 0)],
    "R": [(r"(?<![M][EA]IE)(?<=IE)R$", "", "R", 1), (r"RR?", "R", None, 0)],
    "S": [
        (r"(?<=[IY])SL", "", None, 1), (r"^SUGAR", "X", "S", 1), (r"SH(?=EIM|OEK|OLM|OLZ)", "S", None, 2), (r"SH", "X", None, 2), (r"SI[OA]", "S", "X", 3),
        (r"^S(?=[MNLW])", "S", "X", 1), (r"SZ", "S", "X", 2), (r"SCH(?=ER|EN)", "X", "SK", 3), (r"SCH(?=OO|UY|ED|EM)", "SK", None, 3), (rf"^SCH(?![{V}W])", "X", "S", 3), (r"SCH", "X", None, 3),
        (r"SC[IEY]", "S", None, 3), (r"SC", "SK", None, 3), (r"(?<=[AO]I)S$", "", "S", 1), (r"SS", "S", None, 2), (r"S", "S", None, 1),
    ],
    "T": [(r"TION", "X", None, 3), (r"TIA|TCH", "X", None, 3), (r"TH(?=OM|AM)", "T", None, 2), (r"TTH", "0", "T", 3), (r"TH", "0", "T", 2), (r"T[TD]", "T", None, 2), (r"T", "T", None, 1)],
    "V": [("VV?", "F", None, 0)],
    "W": [(r"WR", "R", None, 2), (rf"^W(?=[{V}])", "A", "F", 1), (r"^WH", "A", None, 1), (rf"(?<=[{V}])W$|(?<=[EO])W(?=SK[IY])|(?<=^SCH)W", "", "F", 1), (r"WI[CT]Z", "TS", "FX", 4), (r"W", "", None, 1)],
    "X": [(r"^X", "S", None, 1), (r"(?<=[IE]AU)X$|(?<=[AO]U)X$", "", None, 1), (r"X[CX]", "KS", None, 2), (r"X", "KS", None, 1)],
    "Z": [(r"ZH", "J", None, 2), (r"ZZ?(?=[OIA])", "S", "TS", 0), (r"ZZ?", "S", None, 0)],
}
TABLE = {letter: [(re.compile(p), a, a if b is None else b, n) for p, a, b, n in rules] for letter, rules in RULES.items()}
SILENT = re.compile(r"^(?:GN|KN|PN|WR|PS)")


@lru_cache(65536)
def codes(name: str) -> tuple[str, str]:
    """The two codes of a name; equal where there is no alternate, empty where it has no letter from A to Z."""
    plain = unicodedata.normalize("NFKD", name.upper().replace("ß", "SS")).encode("ascii", "ignore").decode()
    word = re.sub(r"[^A-Z ]", "", plain).strip()
    at, first, other = (1 if SILENT.match(word) else 0), [], []
    while at < len(word):
        for pattern, a, b, taken in TABLE.get(word[at], ()):
            if m := pattern.match(word, at):
                first.append(a)
                other.append(b)
                at += taken or len(m[0])
                break
        else:
            at += 1
    return "".join(first), "".join(other)


@pandas_udf(ArrayType(StringType()))
def phonetic_codes(names: pd.Series) -> pd.Series:
    """The distinct codes of each name, first the main one; none for null or what has no letters."""
    return names.map(lambda x: [c for c in dict.fromkeys(codes(x)) if c] if x else [])
