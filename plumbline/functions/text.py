"""Text as columns: everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EXCEL_ERRORS, PLACEHOLDERS, VALUE_CHARS

DATE_LADDER = (
    # Fixed values, in order: name, form, pattern for the parser.
    ("%Y-%m-%d", r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    ("%d/%m/%Y", r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    ("%m/%d/%Y", r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    ("%d-%m-%Y", r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    ("%m-%d-%Y", r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    ("%Y/%m/%d", r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    ("%d.%m.%Y", r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    ("%d %b %Y", r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    ("%d %B %Y", r"^\d{1,2} [A-Za-z]{3,9} \d{4}$", "d MMMM yyyy"),
    ("%b %d, %Y", r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    ("%Y%m%d", r"^\d{8}$", "yyyyMMdd"),
    ("%d-%b-%Y", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    ("%d-%b-%y", r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", "d-MMM-yyyy"),
    ("%m/%d/%y", r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yyyy"),
    ("%d/%m/%y", r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yyyy"),
)
ISO_TIME = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"

# Forms without a fixed order of parts: what may hold one, and how its parts are found once weekdays and commas are gone.
FREE = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)|^\d{1,2}[/.-]\d{1,2}[/.-]\d{4},? +\d{1,2}:\d{2}"
WEEKDAY = r"^(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+"
MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?\.?"
CLOCK = r"^(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)? ?([ap]m)?$"
#: A zone after a clock time: universal time by name, with or without hours from it, or hours from it alone.
ZONE = r"(?<=[\dm]) ?(?:z|(?:utc|gmt)?(?: ?([+-])(\d{2}):?(\d{2})?)?)$"


def strip(x: Column) -> Column:
    """Without white space (Unicode) at either end; null stays null."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def trimmed(x: Column) -> Column:
    """Stripped, null as the empty text."""
    return strip(F.coalesce(x, F.lit("")))


def is_placeholder(v: Column) -> Column:
    return F.lower(v).isin(*PLACEHOLDERS)


def present(x: Column) -> Column:
    """Neither null nor blank nor a placeholder; never null itself."""
    v = trimmed(x)
    return (v != "") & ~is_placeholder(v)


def mask(v: Column) -> Column:
    """Format signature: runs of digits 9, capitals A, small letters a, white space one space."""
    for pattern, to in ((r"(?U)\d+", "9"), (r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"(?U)\s+", " ")):
        v = F.regexp_replace(v, pattern, to)
    return v


def casing(v: Column) -> Column:
    """none, upper, lower, title or mixed."""
    letters, big, small = (v.rlike(p) for p in (r"\p{L}", r"\p{Lu}", r"\p{Ll}"))
    title = v.rlike(r"^[^\p{L}]*\p{Lu}") & v.rlike(r"^\p{Lu}") & ~v.rlike(r"(^|[ ])[\p{L}&&[^\p{Lu}]]")
    return F.when(~letters, "none").when(~small, "upper").when(~big, "lower").when(title, "title").otherwise("mixed")


def number(x: Column) -> Column:
    """A number after dropping separators and currency signs, else null."""
    clean = F.regexp_replace(trimmed(x), r"[,\s$€£₹]", "")
    return F.when(clean.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), clean.cast("double"))


def century(v: Column) -> Column:
    """A two-digit year at the end as a four-digit one: from 69 on the last century."""
    two = F.right(v, F.lit(2))
    return F.concat(v.substr(F.lit(1), F.length(v) - 2), F.when(two >= "69", "19").otherwise("20"), two)


def date_steps(v: Column) -> list[tuple[str, Column]]:
    """(format, timestamp or null) of each step of the ladder, then of ISO date-times."""
    out = []
    for name, form, pattern in DATE_LADDER:
        text = century(v) if name.endswith("%y") else v
        if "MMM" in pattern:
            text = F.initcap(F.replace(text, F.lit("-"), F.lit(" ")))
            pattern = pattern.replace("-", " ")
        out.append((name, F.when(v.rlike(form), F.try_to_timestamp(text, F.lit(pattern)))))
    return [*out, ("mixed", F.when(v.rlike(ISO_TIME), v.try_cast("timestamp")).when(v.rlike(FREE), free_date(v)))]


def free_date(v: Column) -> Column:
    """A date with a named month, or a numeric one with a clock time: weekday, ordinals, commas, am or pm and a zone (taken to universal time) are read; numeric ones month first where they can be."""
    t = F.regexp_replace(F.regexp_replace(F.lower(v), WEEKDAY, ""), r"(?<=\d)(?:st|nd|rd|th)\b", "")
    t = F.regexp_replace(t, r"[,\s]+(?:at )?", " ")
    for form, to in (
        (rf"^(\d{{1,2}})[ -]{MONTH}[ -](\d{{4}})(?: |$)", "$1 $2 $3|"),
        (rf"^{MONTH}[ -](\d{{1,2}})[ -](\d{{4}})(?: |$)", "$2 $1 $3|"),
        (rf"^(\d{{4}})[ -]{MONTH}[ -](\d{{1,2}})(?: |$)", "$3 $2 $1|"),
        (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}) ", "$1/$2/$3|"),
    ):
        t = F.regexp_replace(t, form, to)
    day, whole = F.substring_index(t, "|", 1), F.when(F.contains(t, F.lit("|")), F.substring_index(t, "|", -1))
    clock = F.regexp_replace(whole, ZONE, "")
    ahead = [F.coalesce(F.regexp_extract(whole, ZONE, k).try_cast("int"), F.lit(0)) for k in (2, 3)]
    zone = (ahead[0] * 60 + ahead[1]) * F.when(F.regexp_extract(whole, ZONE, 1) == "-", -1).otherwise(1)
    at = F.coalesce(F.try_to_timestamp(F.initcap(day), F.lit("d MMM yyyy")), F.try_to_timestamp(day, F.lit("M/d/yyyy")), F.try_to_timestamp(day, F.lit("d/M/yyyy")))
    hour, minute, second = (F.coalesce(F.regexp_extract(clock, CLOCK, k).try_cast("int"), F.lit(0)) for k in (1, 2, 3))
    half = F.regexp_extract(clock, CLOCK, 4)
    fits = (minute < 60) & (second < 60) & F.when(half == "", hour < 24).otherwise(hour.between(1, 12))
    of_day = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "pm", 12).otherwise(0))
    return F.when(whole == "", at).when(clock.rlike(CLOCK) & fits & (ahead[0] < 24) & (ahead[1] < 60), at + F.make_dt_interval(F.lit(0), of_day, minute - zone, second.cast("decimal(18,6)")))


def date(x: Column) -> Column:
    """The first reading of a date that the ladder gives, else null."""
    return F.coalesce(*[t for _, t in date_steps(trimmed(x))])


def date_format(x: Column) -> Column:
    """The name of the first format that reads a date; ``other`` for what none reads, empty for blanks."""
    v = trimmed(x)
    out = F.when(v == "", F.lit(""))
    for name, t in date_steps(v):
        out = out.when(t.isNotNull(), F.lit(name if name != "mixed" else "other"))
    return out.otherwise(F.lit("other"))


def normalised(x: Column) -> Column:
    """Lower case, anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9]+", " "))


def shown(x: Column) -> Column:
    """A value as examples show it."""
    return F.when(x.isNull(), "(null)").when(strip(x) == "", "(blank)").otherwise(F.left(x, F.lit(VALUE_CHARS)))


def unformula(x: Column) -> Column:
    """Spreadsheet errors as null, ``="..."`` formulas as their text; other white space stays."""
    text = F.regexp_replace(F.regexp_replace(x, r"^\s*=\s*", ""), r'^"|"$', "")
    return F.when(strip(x).isin(*EXCEL_ERRORS), F.lit(None).cast("string")).when(x.rlike(r"^\s*="), text).otherwise(x)
