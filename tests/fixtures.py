"""A membership table drawn by a seed, defects at drawn rows, and a manifest of how many there are of each kind."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, timedelta

AS_OF = date(2024, 7, 1)
COLUMNS = ["member_id", "contact_name", "contact_email", "mobile_phone", "home_city", "country", "joined_date", "last_activity_date", "member_status", "paid_amount", "currency_code", "batch_no", "modified_by"]
SYLLABLES = ["ba", "co", "di", "fe", "gu", "ha", "jo", "ki", "lu", "mo", "ne", "pa", "ri", "so", "tu", "va", "we", "zo"]
TIERS = ["bronze", "silver", "gold"]


def word(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(SYLLABLES) for _ in range(n)).capitalize()


def member(rng: random.Random, k: int, towns: list[str]) -> dict[str, str | None]:
    name = f"{word(rng, 3)} {word(rng, 4)}"
    joined = AS_OF - timedelta(days=rng.randrange(300, 900))
    return {
        "member_id": f"M{k:05d}",
        "contact_name": name,
        "contact_email": f"{name.replace(' ', '_').lower()}{k}@{rng.choice(['gmail.com', 'outlook.com', 'gmx.com'])}",
        "mobile_phone": f"+1 {rng.randrange(200, 999)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}",
        "home_city": rng.choice(towns),
        "country": rng.choice(["US", "CA", "GB"]),
        "joined_date": joined.isoformat(),
        "last_activity_date": (AS_OF - timedelta(days=rng.randrange(1, 200))).isoformat(),
        "member_status": rng.choice(TIERS),
        "paid_amount": str(rng.randrange(1000, 5000)),
        "currency_code": rng.choice(["USD", "CAD", "GBP"]),
        "batch_no": str(k // 50),
        "modified_by": "nightly",
    }


def table(members: list[dict[str, str | None]]) -> tuple[list[tuple], list[str]]:
    return [tuple(m[c] for c in COLUMNS) for m in members], COLUMNS


def members(rng: random.Random, n: int) -> list[dict[str, str | None]]:
    towns = [word(rng, 3) for _ in range(8)]
    return [member(rng, k, towns) for k in range(n)]


def clean(n: int = 320, seed: int = 20) -> tuple[list[tuple], list[str]]:
    return table(members(random.Random(seed), n))


#: kind of defect: (column, how the value becomes wrong, how many).
SPOILT = {
    "missing mail": ("contact_email", lambda v, rng: None, 17),
    "stand-in mail": ("contact_email", lambda v, rng: rng.choice(["N/A", "unknown", "TBD"]), 13),
    "mail form": ("contact_email", lambda v, rng: rng.choice([v.replace("@", " at "), v.replace(".com", "")]), 11),
    "misspelt domain": ("contact_email", lambda v, rng: v.split("@")[0] + "@" + rng.choice(["gmial.com", "outlok.com"]), 7),
    "short phone": ("mobile_phone", lambda v, rng: rng.choice(["12", "call me"]), 9),
    "unreadable date": ("joined_date", lambda v, rng: "some day", 8),
    "date to come": ("joined_date", lambda v, rng: (AS_OF + timedelta(days=rng.randrange(30, 90))).isoformat(), 6),
    "long silent": ("last_activity_date", lambda v, rng: (AS_OF - timedelta(days=rng.randrange(1500, 1600))).isoformat(), 14),
    "rare tier": ("member_status", lambda v, rng: "zinc", 5),
    "spaces": ("contact_name", lambda v, rng: f" {v}  ", 12),
    "capitals": ("home_city", lambda v, rng: v.upper(), 10),
    "no country": ("country", lambda v, rng: "Atlantis", 9),
    "no currency": ("currency_code", lambda v, rng: "ZZZ", 8),
    "far amount": ("paid_amount", lambda v, rng: "88888888888", 4),
}
AGAIN = 15


def dirty(n: int = 480, seed: int = 21) -> tuple[list[tuple], list[str], Counter]:
    """Rows, columns, and how many rows have each kind of defect; rows that occur twice have no other one."""
    rng = random.Random(seed)
    made, manifest = members(rng, n), Counter()
    places = list(range(n))
    rng.shuffle(places)
    for kind, (column, spoil, k) in SPOILT.items():
        for _ in range(k):
            m = made[places.pop()]
            m[column] = spoil(m[column], rng)
            manifest[kind] += 1
    twice = [dict(made[places.pop()]) for _ in range(AGAIN)]
    manifest["again"] = len(twice)
    return *table([*made, *twice]), manifest
