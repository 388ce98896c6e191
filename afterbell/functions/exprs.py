"""Column expressions that all operators share. Missing values are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "missing" and texts that mean "true".
BLANKS = ("", "nan", "none", "null")
TRUE_WORDS = ("true", "1", "yes", "y")


def norm(c: Column, missing: str = "unknown") -> Column:
    """Category text: trimmed, lower case, ``missing`` for NULL."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(missing))))


def blank_to_null(c: Column, also: Sequence[str] = ()) -> Column:
    """NULL for the blank words in any case, else the trimmed text."""
    text = F.trim(c.cast("string"))
    return F.when(F.lower(text).isin(*BLANKS, *also), None).otherwise(text)


def truthy(c: Column, also: Sequence[str] = ()) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS, *also), F.lit(False))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clean_number(c: Column) -> Column:
    """Numbers out of texts such as ``$1,234`` or ``12%`` (a percent sign divides by 100); NULL if there is none."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"[$,\s]", "")
    value = F.regexp_replace(text, "%$", "").try_cast("double")
    return nan_to_null(F.when(text.endswith("%"), value / 100).otherwise(value))


def safe_pct_delta(actual: Column, expected: Column) -> Column:
    """(actual - expected) / |expected|, NULL where expected is 0 or missing."""
    return F.try_divide(actual - expected, F.abs(expected))


def repair_pct(c: Column) -> Column:
    """Fractions: values beyond 1 are percents."""
    return F.when(F.abs(c) > 1, c / 100).otherwise(c)


def mid(value: Column, low: Column, high: Column) -> Column:
    return F.coalesce(value, (low + high) / 2)


def horizontal_mean(columns: Sequence[Column]) -> Column:
    """Mean over the columns that aren't NULL; NULL if all are."""
    known = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.try_divide(total, known)


def count_known(columns: Sequence[Column]) -> Column:
    return sum((F.when(c.isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))


def direction(c: Column, band: float, up: str = "positive", down: str = "negative", flat: str = "flat") -> Column:
    """Label outside a flat band, strict on both sides; ``unknown`` for NULL."""
    return F.when(c.isNull(), "unknown").when(c > band, up).when(c < -band, down).otherwise(flat)


def labels_above(c: Column, cuts: Sequence[tuple[float, str]], low: str, missing: str = "unknown") -> Column:
    """The label of the first (highest) cut that the value reaches, ``low`` below all."""
    out = F.when(c.isNull(), missing)
    for cut, label in cuts:
        out = out.when(c >= cut, label)
    return out.otherwise(low)


def right_closed_bucket(c: Column, edges: Sequence[float], labels: Sequence[str], missing: str = "unknown") -> Column:
    """Buckets (a, b] between edges; the last label is above the last edge."""
    out = F.when(c.isNull(), missing)
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(c <= edge, label)
    return out.otherwise(labels[-1])


def log_to_simple(c: Column) -> Column:
    return F.expm1(c)


def simple_to_log(c: Column) -> Column:
    return F.when(c > -1, F.log1p(c))


#: The polynomial approximation 7.1.26 of the error function (Abramowitz and Stegun).
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(c: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(c))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(c) * (1 - poly * F.exp(-c * c))


def normal_cdf(c: Column) -> Column:
    return 0.5 * (1 + erf(c / F.sqrt(F.lit(2.0))))


def two_sided_p(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def session_of(ts: Column, open_minute: int = 570, close_minute: int = 960, midnight_unknown: bool = False) -> Column:
    """Release session by the clock: before 09:30, until 16:00, after."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    out = F.when(ts.isNull(), "unknown")
    if midnight_unknown:
        out = out.when((minute == 0) & (F.second(ts) == 0), "unknown")
    return out.when(minute < open_minute, "before_open").when(minute >= close_minute, "after_close").otherwise("intraday")


def stable_id(prefix: str, *parts: Column) -> Column:
    """Content-addressed id: prefix and 16 hex digits of the SHA-256 over the JSON array of the parts."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256), 1, 16))


def issues(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in order, as an array."""
    return F.array_compact(F.array(*[F.when(rule, name) for rule, name in rules]))


def unit_interval(c: Column, name: str) -> Column:
    """The score itself; a score outside [0, 1] raises."""
    return F.when(c.isNull() | c.between(0, 1), c).otherwise(F.raise_error(F.concat(F.lit(f"{name} outside [0, 1]: "), c.cast("string"))).cast("double"))


def collapse_white(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def safe_id(c: Column, most: int = 180) -> Column:
    """Slug of letters, digits, dot, dash and underscore, at most ``most`` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), 1, most)


def starts_of(lengths: Column, block: int = 256) -> Column:
    """For an array of lengths of things one after another, the array of their starts.

    Summed inside blocks and over them: an array that grows step by step is copied at every step,
    which over one long array would take time with its square.
    """

    def running(c: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(c, start, step, lambda acc: acc["out"])

    last = F.greatest(F.ceil(F.size(lengths) / block) - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda b: F.slice(lengths, b * block + 1, block))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
    return F.flatten(F.zip_with(blocks, running(totals), lambda b, at: F.transform(running(b), lambda x: x + at)))
