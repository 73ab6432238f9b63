"""Cleaning, parsing and formatting as Column -> Column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' scripts see it, inside a Java character class.
WS = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
REDACTED_NAMES = ("REDACTED", "REDACTED DATA", "REDACTED PERSONAL DATA", "Redacted", "Redacted Data", "Redacted Personal Data")


def full_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+\z", "")


def normalise_name(c: Column) -> Column:
    """Key of a supplier name: upper case, only ASCII word characters, & and single spaces."""
    kept = F.regexp_replace(F.upper(c), rf"[^A-Za-z0-9_&{WS}]", "")
    return full_trim(F.regexp_replace(kept, rf"[{WS}]+", " "))


def parse_amount(c: Column) -> Column:
    """Leading number of a string without £ and commas; 0 where there is none."""
    number = rf"^[{WS}]*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"
    return F.coalesce(F.regexp_extract(F.regexp_replace(c, "[£,]", ""), number, 1).try_cast("double"), F.lit(0.0))


def parse_date(c: Column) -> Column:
    """d/m/yyyy (also - and .) or a leading yyyy-mm-dd as yyyy-mm-dd, without a range check; else empty."""
    dmy = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})\z"
    part = lambda i: F.regexp_extract(c, dmy, i)
    return F.when(c.rlike(dmy), F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))).otherwise(F.coalesce(F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def serial_date(n: Column) -> Column:
    """Spreadsheet serial (1900 system) as yyyy-mm-dd."""
    return F.date_format(F.when(n < 60, F.date_add(F.lit("1899-12-31").cast("date"), F.floor(n).cast("int"))).otherwise(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int"))), "yyyy-MM-dd")


def month_of_filename(c: Column) -> Column:
    full, short = r"(\d{4})[- _](\d{2})[- _]\d{2}", r"(\d{4})[- _](\d{2})"
    pick = lambda p: F.concat_ws("-", F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2))
    return F.when(c.rlike(full), pick(full)).when(c.rlike(short), pick(short)).otherwise(F.lit(""))


def fy_label(year: Column, month: Column) -> Column:
    """2024-25 for April 2024 to March 2025."""
    y = F.when(month >= 4, year).otherwise(year - 1).cast("int")
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def fy_of_month(c: Column) -> Column:
    """Label of a yyyy-mm text; empty if it isn't one."""
    ok = c.rlike(r"^\d{4}-\d{2}")
    return F.when(ok, fy_label(F.substring(c, 1, 4).try_cast("int"), F.substring(c, 6, 2).try_cast("int"))).otherwise(F.lit(""))


def fy_bounds(c: Column) -> tuple[Column, Column]:
    """First and last day of a year's label: 2024-04-01 and 2025-03-31 for 2024-25."""
    first = F.substring_index(c, "-", 1).try_cast("int")
    return F.concat(first.cast("string"), F.lit("-04-01")), F.concat((first + 1).cast("string"), F.lit("-03-31"))


def previous_fy(c: Column) -> Column:
    """2023-24 for 2024-25."""
    first = F.split(c, "-")[0]
    return F.concat((first.try_cast("int") - 1).cast("string"), F.lit("-"), F.right(first, F.lit(2)))


def like_ascii(c: Column, pattern: str) -> Column:
    """c LIKE %pattern% with ASCII case folding; % and _ in the pattern are wildcards, a backslash is itself."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = pattern.translate(str.maketrans(upper, lower)).replace("\\", "\\\\")
    return F.translate(c, upper, lower).like(f"%{folded}%")


def blank_label(c: Column, label: str) -> Column:
    return F.when(F.coalesce(full_trim(c), F.lit("")) == "", F.lit(label)).otherwise(c)


def redacted_strict(name: Column) -> Column:
    """One of the redacted spellings, or no name at all."""
    return name.isin(*REDACTED_NAMES) | name.isNull()


def redacted_loose(name: Column) -> Column:
    """A name that begins with REDACTED in any case."""
    return F.coalesce(F.upper(full_trim(name)).startswith("REDACTED"), F.lit(False))


def to_fixed(c: Column, decimals: int = 0) -> Column:
    """A double with so many decimals, rounded half away from zero on its exact binary value.

    Formatting rounds the shortest decimal form, which takes 1.15, a little less in binary, for a half. Here |c| * 2 * 10^decimals is
    computed as a product and its exact error (Dekker); an odd product with a negative error is just below a half.
    """
    x, twice = F.abs(c.cast("double")), float(2 * 10**decimals)
    spread = x * 134217729.0
    high = spread - (spread - x)
    product = x * twice
    error = (high * twice - product) + (x - high) * twice
    half_up = F.floor((product + 1) / 2)
    just_below = (product % 2 == 1) & (error < 0)
    whole = half_up - just_below.cast("long")
    unit = 10**decimals
    shown = F.concat(F.floor(whole / unit).cast("string"), F.lit("."), F.lpad((whole % unit).cast("string"), decimals, "0")) if decimals else whole.cast("string")
    return F.when(c < 0, F.concat(F.lit("-"), shown)).otherwise(shown)


def grouped(c: Column, decimals: int = 0) -> Column:
    return F.format_string(f"%,.{decimals}f", c.cast("double"))


def currency(c: Column, decimals: int = 0) -> Column:
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), F.lit("£"), grouped(F.abs(c), decimals))


def short_amount(c: Column, plain: bool = True) -> Column:
    """£1.2bn, £1.2m, £1k; below a thousand ungrouped (plain) or as currency."""
    x = c.cast("double")
    size = F.abs(x)
    last = F.concat(F.lit("£"), to_fixed(x, 0)) if plain else currency(x)
    scaled = lambda unit, decimals, mark: F.concat(F.lit("£"), to_fixed(x / unit, decimals), F.lit(mark))
    return F.when(size >= 1e9, scaled(1e9, 1, "bn")).when(size >= 1e6, scaled(1e6, 1, "m")).when(size >= 1e3, scaled(1e3, 0, "k")).otherwise(last)


def month_label(c: Column, whole_year: bool = False) -> Column:
    """Jan 24 for 2024-01, or Jan 2024; what isn't a month is echoed."""
    m = F.substring(c, 6, 2).try_cast("int")
    year = F.substring(c, 1, 4) if whole_year else F.substring(c, 3, 2)
    return F.when(c.rlike(r"^\d{4}-\d{2}") & m.between(1, 12), F.concat(F.get(F.array(*map(F.lit, MONTHS)), m - 1), F.lit(" "), year)).otherwise(c)


def truncated(c: Column, most: int) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


#: Words that leave a public body's short name, in the order in which they go.
SLUG_WORDS = ("council", "city of", "borough of", "royal borough of", "london borough of", "metropolitan borough", "district", "county")


def slug(c: Column) -> Column:
    """Short address name of a public body."""
    out = F.lower(c)
    for words in SLUG_WORDS:
        out = F.regexp_replace(out, rf"\b{words}\b", "")
    return F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def document_type(filename: Column) -> Column:
    return F.when(F.lower(filename).contains("purchase-card"), F.lit("procurement_card")).otherwise(F.lit("expenditure"))


def severity(x: Column, high: float, medium: float) -> Column:
    return F.when(x > high, F.lit("high")).when(x > medium, F.lit("medium")).otherwise(F.lit("low"))
