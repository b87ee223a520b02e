"""Cell-level parsing, formatting and arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabweave.functions.missing import CLIENT_TOKENS, text_missing

PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
THOUSANDS = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
# Currency signs that may lead a number.
CURRENCY = "$€£₹¥₩₫"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\r\n"))


def clean_number(c: Column) -> Column:
    """A leading currency sign, a trailing percent sign (not divided), commas and blanks dropped, (123) read as -123; null if no number."""
    t = F.regexp_replace(trim(c), f"^[{CURRENCY}]", "")
    t = F.regexp_replace(F.regexp_replace(t, "%$", ""), r"[,\s]", "")
    t = F.regexp_replace(t, r"^\(([0-9.]+)\)$", "-$1")
    return F.when(~text_missing(c, CLIENT_TOKENS) & F.rlike(t, F.lit(PLAIN)), t.try_cast("double"))


def strict_number(c: Column) -> Column:
    """A plain, exponent or thousands-grouped number, else null."""
    t = trim(c)
    return F.when(F.rlike(t, F.lit(PLAIN)) | F.rlike(t, F.lit(THOUSANDS)), F.regexp_replace(t, ",", "").try_cast("double"))


def parse_datetime(c: Column) -> Column:
    """ISO (optional time and zone), day/month/year (day first unless impossible) or a month name; naive is UTC; null otherwise."""
    t = trim(c)
    iso = F.rlike(t, F.lit(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?( ?([zZ]|[+-][0-9]{2}:?[0-9]{2}))?)?$"))
    zone = F.regexp_replace(F.regexp_replace(F.upper(t), r" ?([+-][0-9]{2}):?([0-9]{2})$", "$1:$2"), " ?Z$", "Z")
    a_iso = F.when(iso, F.try_to_timestamp(F.when(F.rlike(t, F.lit(r"[T ][0-9]")), zone).otherwise(t)))
    dmy = F.rlike(t, F.lit(r"^[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}( [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$"))
    part = lambda i: F.regexp_extract(t, r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})", i)
    swap = (part(2).try_cast("int") > 12) & (part(1).try_cast("int") <= 12)
    day, month = F.when(swap, part(2)).otherwise(part(1)), F.when(swap, part(1)).otherwise(part(2))
    clock = F.regexp_extract(t, r" ([0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)$", 1)
    text = F.concat_ws("-", part(3), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    a_dmy = F.when(dmy, F.try_to_timestamp(F.concat_ws(" ", text, F.nullif(clock, F.lit("")))))
    named = [F.when(F.rlike(t, F.lit(r"^[A-Za-z]{3,9} [0-9]{1,2},? [0-9]{4}$")), F.try_to_timestamp(F.regexp_replace(t, r"^([A-Za-z]{3})[a-z]* ([0-9]{1,2}),? ([0-9]{4})$", "$2 $1 $3"), F.lit("d MMM yyyy")))]
    named.append(F.when(F.rlike(t, F.lit(r"^[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4}$")), F.try_to_timestamp(F.regexp_replace(t, r"^([0-9]{1,2}) ([A-Za-z]{3})[a-z]* ([0-9]{4})$", "$1 $2 $3"), F.lit("d MMM yyyy"))))
    return F.coalesce(a_iso, a_dmy, *named)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def compact(x: Column) -> Column:
    """1.2K, 3.4M."""
    return F.when(F.abs(x) >= 1e6, F.concat(F.format_string("%.1f", F.round(x / 1e6, 1)), F.lit("M"))).when(F.abs(x) >= 1e3, F.concat(F.format_string("%.1f", F.round(x / 1e3, 1)), F.lit("K"))).otherwise(F.format_string("%.0f", F.round(x)))


def signed_delta(x: Column, digits: int = 2) -> Column:
    return F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit("")), F.format_string(f"%.{digits}f", F.round(x, digits)))


def sha256(c: Column) -> Column:
    """The SHA-256 of a text, in hexadecimal."""
    return F.sha2(c, 256)


def iso_date(t: Column) -> Column:
    """A moment as 2024-01-31T10:20:30.123Z."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def relative_time(t: Column, now: Column) -> Column:
    """just now, 5m ago, 3h ago, 2d ago, and from a week on the date (Jan 5, 2024)."""
    s = F.floor((F.unix_millis(now) - F.unix_millis(t)) / 1000)
    ago = lambda per, unit: F.concat(F.floor(s / per).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, ago(60, "m")).when(s < 86_400, ago(3600, "h")).when(s < 7 * 86_400, ago(86_400, "d")).otherwise(F.date_format(t, "MMM d, yyyy"))


# How states, verdicts and strategies are shown.
STATUS_LABELS = {"pending": "Pending", "running": "Running", "completed": "Completed", "failed": "Failed"}
VERDICT_LABELS = {"recommended": "Augmentation Recommended", "not_recommended": "Augmentation Not Recommended", "inconclusive": "Inconclusive"}
STRATEGY_LABELS = {"smote": "SMOTE", "adasyn": "ADASYN", "smote_tomek": "SMOTE-Tomek", "oversampling": "Random Oversampling", "noise_injection": "Noise Injection", "combined": "Combined Strategy"}


def labelled(c: Column, labels: dict[str, str]) -> Column:
    """The label of a value; a value without one as it stands."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in labels.items() for v in pair]), c), c)


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def file_size(x: Column) -> Column:
    """Bytes in units of 1024."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(x < kb, F.concat(x.cast("bigint").cast("string"), F.lit(" B")))
        .when(x < mb, F.concat(F.format_string("%.1f", x / kb), F.lit(" KB")))
        .when(x < gb, F.concat(F.format_string("%.1f", x / mb), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.1f", x / gb), F.lit(" GB")))
    )


def csv_field(c: Column) -> Column:
    """Quoted where it holds a separator, quote or line end; null is empty."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("")).when(F.rlike(s, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def sql_literal(c: Column) -> Column:
    """NULL for null and empty, numeric-looking text as it stands, else quoted with doubled quotes."""
    s = c.cast("string")
    return F.when(s.isNull() | (s == ""), F.lit("NULL")).when(F.rlike(trim(s), F.lit(PLAIN)), trim(s)).otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'")))
