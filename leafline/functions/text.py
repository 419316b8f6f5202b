"""Column expressions over recognised text, settings and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space that trimming removes.
BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Names of settings whose values are masked in logs.
SECRET = r"(?i)\b(secretKey|apiKey|api_key|token|password)=[^&\s\"']+"


def trim(t: Column) -> Column:
    return F.regexp_replace(t, f"^{BLANK}+|{BLANK}+$", "")


def characters(t: Column) -> Column:
    return F.filter(F.split(t, ""), lambda c: c != "")


def most_frequent(t: Column) -> Column:
    """Count of the most frequent character that is no space: the longest run of the sorted characters."""
    chars = F.array_sort(F.filter(characters(t), lambda c: c != " "))
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(s, c):
        n = F.when(s["c"] == c, s["n"] + 1).otherwise(F.lit(1))
        return F.struct(c.alias("c"), n.alias("n"), F.greatest(s["most"], n).alias("most"))

    return F.aggregate(chars, start, step, lambda s: s["most"])


def longest_run(t: Column) -> Column:
    """Length of the longest run of one character."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(t, F.lit(r"(?s)((.)\2*)"), F.lit(1)), F.length)), F.lit(0))


def is_garbage(t: Column) -> Column:
    """Recognition noise: nothing, one character run of four and a third of the text, one character half of it, or hardly anything useful."""
    s = trim(t)
    length, solid = F.length(s), F.length(F.regexp_replace(s, " ", ""))
    useful = F.length(F.regexp_replace(s, r"[^0-9A-Za-z\x{4e00}-\x{9fff}]", ""))
    run = longest_run(s)
    return (length == 0) | ((run >= 4) & (3 * run >= length)) | ((solid >= 6) & (2 * most_frequent(s) >= solid)) | ((useful < 2) & (length >= 4))


def is_sparse(t: Column, width: Column, height: Column) -> Column:
    """A line whose text is far too short for its box."""
    return 2 * F.length(trim(F.coalesce(t, F.lit("")))) * F.greatest(F.lit(1), height) < width


def font_runs(t: Column) -> Column:
    """Alternating runs of ASCII and other text as (latin, text)."""
    return F.transform(F.regexp_extract_all(t, F.lit(r"(?s)([\x00-\x7f]+|[^\x00-\x7f]+)"), F.lit(1)), lambda r: F.struct(F.ascii(r).between(0, 127).alias("latin"), r.alias("text")))


def masked(line: Column) -> Column:
    return F.regexp_replace(line, SECRET, "$1=***")


def elapsed(ms: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(ms / 1000))
    h, m, sec = F.floor(s / 3600).cast("string"), F.floor((s % 3600) / 60).cast("string"), (s % 60).cast("string")
    return F.when(s >= 3600, F.concat(h, F.lit(" h "), m, F.lit(" min "), sec, F.lit(" s"))).when(s >= 60, F.concat(m, F.lit(" min "), sec, F.lit(" s"))).otherwise(F.concat(sec, F.lit(" s")))


def finite(v: Column) -> Column:
    """The number, null where it is none or not finite."""
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def number(text: Column) -> Column:
    """A setting's text as a finite number: blank is 0, what is no number is null."""
    return F.when(trim(text) == "", F.lit(0.0)).otherwise(finite(trim(text).try_cast("double")))


def threshold(v: Column, default: float) -> Column:
    """A share stored as percent (1 and more), as a share (between 0 and 1), zero kept; the default for null and numbers that are not finite."""
    v = finite(v)
    return F.when(v.isNull(), F.lit(default)).when(v >= 1, v / 100).when(v > 0, F.floor(v * 100 + 0.5) / 100).otherwise(F.lit(0.0))


def preferences(raw: dict[str, Column]) -> dict[str, Column]:
    """Typed settings from numbers, where null, NaN and infinity mean unset; auto_open, if given, is any type."""
    half_up = lambda x: F.floor(x + 0.5)
    limit, turn, crop, workers = (finite(raw[c]) for c in ("limit_side", "max_rot", "crop_mode", "workers"))
    typed = {
        "limit_side": F.when(limit >= 1, half_up(limit)).otherwise(F.lit(1536)).cast("long"),
        "det_thresh": threshold(raw["det_thresh"], 0.3),
        "box_thresh": threshold(raw["box_thresh"], 0.4),
        "max_rot": F.when(turn.isNull(), F.lit(30)).otherwise(F.least(F.lit(90), F.greatest(F.lit(0), half_up(turn)))).cast("long"),
        "crop_mode": F.when(crop.isin(0.0, 1.0, 2.0), crop).otherwise(F.lit(2)).cast("long"),
        "workers": F.when((workers >= 1) & (workers == F.floor(workers)), F.least(F.lit(8.0), workers)).otherwise(F.lit(4)).cast("long"),
    }
    if "auto_open" in raw:
        typed["auto_open"] = F.coalesce(raw["auto_open"], F.lit(False))
    return typed


def effective(own: dict[str, Column], preference: dict[str, Column]) -> dict[str, Column]:
    """A job's options: its own where it has one, else the preference."""
    return {k: F.coalesce(own[k], p) if k in own else p for k, p in preference.items()}


def clamped(value: Column, low: float, high: float, default: Column | float) -> Column:
    """A number within bounds; the default for what is no finite number."""
    v = finite(value)
    return F.when(v.isNull(), default if isinstance(default, Column) else F.lit(default)).otherwise(F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), v)))


def one_of(value: Column, choices: tuple, default: Column | int) -> Column:
    """A number that is one of the choices, else the default."""
    v = finite(value)
    return F.when(v.isin(*[float(c) for c in choices]), v).otherwise(default if isinstance(default, Column) else F.lit(float(default)))


def percent(value: Column, default: int) -> Column:
    """A share as stored (percent, or an older share below 1) as percent; the default for what is no number."""
    v = F.when(~F.isnan(value), value)
    return F.when(v.isNull(), F.lit(float(default))).when((v > 0) & (v < 1), F.floor(v * 100 + 0.5)).otherwise(v)


def job_name(millis: Column, number: Column) -> Column:
    """A job's identifier."""
    return F.concat(F.lit("job-"), millis.cast("string"), F.lit("-"), number.cast("string"))


def page_indexes(pages: Column) -> Column:
    """Pages numbered from 1 as indexes from 0."""
    return F.transform(pages, lambda p: p - 1)


def page_list(spec: Column, n_pages: Column, current: Column) -> Column:
    """1-based pages that a specification names, ascending and distinct."""
    text = trim(F.coalesce(spec, F.lit("")))
    tokens = F.when(text == "", F.array(current.cast("string"))).otherwise(F.split(text, r"[,\s]+"))

    def pages(t: Column) -> Column:
        a, b = F.try_to_number(F.regexp_extract(t, r"^(\d+)", 1), F.lit("999999999")).cast("long"), F.try_to_number(F.regexp_extract(t, r"(\d+)$", 1), F.lit("999999999")).cast("long")
        lo, hi = F.greatest(F.lit(1).cast("long"), F.least(a, b)), F.greatest(a, b)
        hi = F.when(n_pages > 0, F.least(hi, n_pages)).otherwise(hi)
        return F.when(t.rlike(r"^\d+([-\x{2013}~]\d+)?$") & (lo <= hi), F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, pages))))


def clipped(text: Column, x1: Column, x2: Column, left: Column, right: Column) -> Column:
    """The part of a text whose box [x1, x2] lies inside [left, right], all characters equally wide; trimmed, empty outside."""
    w = (x2 - x1).cast("double")
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - x1) / w))
    a, b, n = share(F.greatest(x1, left)), share(F.least(x2, right)), F.length(text)
    start = F.floor(a * n + 0.5)
    piece = F.substring(text, (start + 1).cast("int"), (F.floor(b * n + 0.5) - start).cast("int"))
    return F.when((w >= 1) & (b > a), trim(piece)).otherwise(F.lit(""))


def title_or_file(title: Column, path: Column) -> Column:
    """The title, or else the last part of the path."""
    return F.coalesce(F.nullif(title, F.lit("")), F.element_at(F.split(path, r"[\\\\/]"), -1))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def language(locale: Column) -> Column:
    return F.when(F.startswith(F.lower(locale), F.lit("zh")), "zh").otherwise("en")
