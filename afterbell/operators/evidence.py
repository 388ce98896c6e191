"""From texts to claims with evidence spans: segmentation, rules, amounts. Offsets are 0-based code points of the text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from afterbell.functions.exprs import collapse_white, stable_id, starts_of


@dataclass(frozen=True)
class Rule:
    """A field that a pattern asserts. Patterns hold no look-around, so that any engine can run them."""

    field: str
    pattern: str
    value: str = "true"
    confidence: float = 0.8
    reject: str | None = None  # a pattern that, in the evidence, takes the claim back
    spared: str | None = None  # unless this is in the evidence too
    need: str | None = None  # a pattern that the evidence must hold


#: After a full stop, semicolon, exclamation or question mark that stands beside no digit, and at a line's end.
BOUNDARY = r"(?<=[.;!?])(?<![0-9][.;!?])(?![0-9])|\n"


def segments(docs: DataFrame, least: int = 6, end: str = BOUNDARY) -> DataFrame:
    """Sentences and lines with offsets: the text up to each boundary with its end mark, trimmed, of at least ``least`` characters.

    A mark beside a digit ends nothing, so decimals and item numbers stay whole.
    """
    pieces, marks = F.split("text", end, -1), F.regexp_extract_all(F.col("text"), F.lit(end), F.lit(0))
    cut = docs.select("doc_id", pieces.alias("_pieces"), marks.alias("_marks"))
    lengths = F.zip_with("_pieces", F.concat("_marks", F.array(F.lit(""))), lambda p, m: F.length(p) + F.length(m))
    placed = cut.select("doc_id", "_pieces", lengths.alias("_lengths")).select("doc_id", F.arrays_zip(starts_of(F.col("_lengths")).alias("start"), F.col("_pieces").alias("piece")).alias("_s"))
    # outer: an inferred filter on the array's size would be pushed below the columns and work them out anew
    rows = placed.select("doc_id", F.posexplode_outer("_s").alias("_k", "s")).select("doc_id", "_k", F.col("s.start").alias("_start"), F.col("s.piece").alias("_piece"))
    left = F.length("_piece") - F.length(F.regexp_replace("_piece", r"^\s+", ""))
    segment = F.regexp_replace(F.regexp_replace("_piece", r"^\s+", ""), r"\s+$", "")
    out = rows.select("doc_id", "_k", (F.col("_start") + left).alias("start_char"), segment.alias("segment"))
    return out.where(F.length("segment") >= least).select("doc_id", "start_char", (F.col("start_char") + F.length("segment")).alias("end_char"), "segment")


def match_rules(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """First match of each rule in each text, with the sentence around it as evidence.

    Rules are literal columns, not a joined table: every text is read once. Columns: doc_id,
    field_name, value, confidence, match_start, start_char, end_char, evidence_text.
    """
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("text").rlike(r.pattern),
                    F.struct(
                        F.lit(r.field).alias("field_name"), F.lit(r.value).alias("value"), F.lit(r.confidence).alias("confidence"), F.lit(r.reject or "").alias("reject"),
                        F.lit(r.spared or "").alias("spared"), F.lit(r.need or "").alias("need"),
                        F.length(F.element_at(F.split("text", r.pattern, 2), 1)).alias("match_start"),
                        F.length(F.regexp_extract("text", r.pattern, 0)).alias("match_length"),
                    ),
                )
                for r in rules
            ]
        )
    )
    rows = docs.select("doc_id", "text", F.explode(hits).alias("h")).select("doc_id", "text", "h.*")
    before = F.expr("substring(text, 1, match_start)")
    after = F.expr("substring(text, match_start + match_length + 1)")
    # the sentence begins after the last end mark before the match and runs to the first one after it
    head = F.element_at(F.split(before, r"[.!?\n]", -1), -1)
    tail_length = F.length(F.element_at(F.split(after, r"[.!?\n]", -1), 1))
    closed = after.rlike(r"[.!?\n]")
    first = F.col("match_start") - F.length(head)
    last = F.col("match_start") + F.col("match_length") + tail_length + F.when(closed, 1).otherwise(0)
    rows = rows.withColumn("_first", first).withColumn("_last", last).withColumn("_raw", F.expr("substring(text, _first + 1, _last - _first)"))
    lead = F.length("_raw") - F.length(F.regexp_replace("_raw", r"^\s+", ""))
    trimmed = F.regexp_replace(F.regexp_replace("_raw", r"^\s+", ""), r"\s+$", "")
    rows = rows.withColumn("start_char", F.col("_first") + lead).withColumn("_trimmed", trimmed)
    rows = rows.withColumn("end_char", F.col("start_char") + F.length("_trimmed")).withColumn("evidence_text", collapse_white(F.col("_trimmed")))
    taken_back = (F.col("reject") != "") & F.expr("evidence_text rlike reject") & ~((F.col("spared") != "") & F.expr("evidence_text rlike spared"))
    kept = rows.where(~taken_back & ((F.col("need") == "") | F.expr("evidence_text rlike need")))
    value = F.when(F.col("value") == "evidence", F.col("evidence_text")).otherwise(F.col("value")).alias("value")
    return kept.select("doc_id", "field_name", value, "confidence", "match_start", "start_char", "end_char", "evidence_text")


def claims_of(matches: DataFrame) -> DataFrame:
    """Claims with ids of their content and of their evidence span."""
    span = stable_id("span", F.col("doc_id"), F.col("field_name"), F.col("start_char"), F.col("end_char"))
    claim = stable_id("claim", F.col("doc_id"), F.col("field_name"), F.col("value"))
    return matches.select(claim.alias("claim_id"), F.col("doc_id").alias("source_doc_id"), "field_name", "value", "confidence", span.alias("evidence_span_id"), "evidence_text", "start_char", "end_char")


_NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
_MONEY = r"\$\s?" + _NUMBER + r"\s?(million|billion|thousand|[MBK]\b)?"
#: Two amounts of which only the second has a unit; the first has the same one.
_SHORT_RANGE = r"\$\s?" + _NUMBER + r"\s*(to|through|-|–|—)\s*\$?\s?" + _NUMBER + r"\s?(million|billion|thousand)"


def _scale(unit: Column) -> Column:
    return F.when(F.lower(unit).isin("million", "m"), 1e6).when(F.lower(unit).isin("billion", "b"), 1e9).when(F.lower(unit).isin("thousand", "k"), 1e3).otherwise(1.0)


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def amounts(c: Column) -> Column:
    """All money amounts of a text as numbers: ``$1.2 million`` is 1200000. The low end of a range has the unit of the high end: ``$3 to $5 billion``."""
    whole = F.regexp_replace(c, "(?i)" + _SHORT_RANGE, r"\$$1 $4 $2 \$$3 $4")
    numbers, units = (F.regexp_extract_all(whole, F.lit("(?i)" + _MONEY), F.lit(g)) for g in (1, 2))
    return F.zip_with(numbers, units, lambda n, u: _number(n) * _scale(u))


def percents(c: Column) -> Column:
    """All percentages of a text as fractions; ``(5.5)%``, ``(5.5%)`` and ``-5.5%`` are negative, ``(5.5% in all)`` isn't: the bracket has to close at once."""
    pattern = r"(\(?)(-?)([0-9]+(?:\.[0-9]+)?)(\)?)\s?(?:%|percent\b)(\)?)"
    opened, minus, numbers, inner, outer = (F.regexp_extract_all(c, F.lit(pattern), F.lit(g)) for g in range(1, 6))
    parts = F.arrays_zip(opened.alias("o"), minus.alias("m"), numbers.alias("n"), inner.alias("i"), outer.alias("u"))
    negative = lambda x: (x["m"] != "") | ((x["o"] != "") & ((x["i"] != "") | (x["u"] != "")))
    return F.transform(parts, lambda x: F.when(negative(x), -1.0).otherwise(1.0) * x["n"].cast("double") / 100)


def stated_range(c: Column) -> Column:
    """(low, high, mid) of a text's money: an amount ``plus or minus`` another or a percentage, else :func:`range_or_mid` of its amounts."""
    around = "(?i)" + _MONEY + r",?\s*(?:plus or minus|\+/-|±)\s*(\$?)\s?" + _NUMBER + r"\s?(million|billion|thousand|%|percent)?"
    part = lambda g: F.regexp_extract(c, around, g)
    mid, far, unit = _number(part(1)) * _scale(part(2)), _number(part(4)), part(5)
    room = F.when(unit.isin("%", "percent"), mid * far / 100).otherwise(far * _scale(F.when(unit == "", part(2)).otherwise(unit)))
    plain = range_or_mid(amounts(c))
    return F.when(part(1) != "", F.struct((mid - room).alias("low"), (mid + room).alias("high"), mid.alias("mid"))).otherwise(plain)


def per_share(c: Column) -> Column:
    """The amounts per share that follow the first earnings-per-share phrase (all the text without one); ``$(0.12)`` is negative."""
    phrase = r"(?i)\beps\b|earnings per share"
    rest = F.when(c.rlike(phrase), F.element_at(F.split(c, phrase, 2), -1)).otherwise(c)
    pattern = r"(\(?-?)\$\s?(\(?-?)([0-9]+\.[0-9]{2})\b"
    before, after, numbers = (F.regexp_extract_all(rest, F.lit(pattern), F.lit(g)) for g in (1, 2, 3))
    return F.zip_with(F.zip_with(before, after, lambda a, b: F.concat(a, b)), numbers, lambda s, n: F.when(s == "", 1.0).otherwise(-1.0) * n.cast("double"))


def range_or_mid(values: Column) -> Column:
    """(low, high, mid) of the first two amounts, in order of size; one amount is all three."""
    two = F.array_sort(F.slice(values, 1, 2))
    return F.struct(F.get(two, F.lit(0)).alias("low"), F.get(two, F.size(two) - 1).alias("high"), ((F.get(two, F.lit(0)) + F.get(two, F.size(two) - 1)) / 2).alias("mid"))


def highlight(text: Column, start: Column, end: Column, around: int = 180) -> Column:
    """HTML of the text around a span, escaped, the span in a mark element."""

    def escape(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    first = F.greatest(start - around, F.lit(0))
    piece = lambda a, b: F.substr(text, a + 1, F.greatest(b - a, F.lit(0)))
    return F.concat(escape(piece(first, start)), F.lit("<mark>"), escape(piece(start, end)), F.lit("</mark>"), escape(piece(end, end + around)))


#: Elements whose content isn't seen; one that is never closed goes on to the end.
HIDDEN = ("script", "style", "noscript", "svg", "head")
_GONE = "(?is)" + "|".join([rf"<{name}\b.*?(?:</{name}\s*>|\z)" for name in HIDDEN] + [r"<!--.*?(?:-->|\z)"])
_BREAKS = r"(?i)</?(?:p|div|li|ul|ol|br|tr|table|h[1-6]|section|article|header|footer|nav|body)\b[^>]*(?:>|\z)"
_TAG = r"</?[a-zA-Z!?][^>]*(?:>|\z)"


def visible_text(html: Column) -> Column:
    """Text of an HTML page by staged replacement: skipped elements out, block tags as line feeds, other tags out, references decoded, white space collapsed.

    What is left open ends with the page, so each pattern passes over it once, whatever it holds.
    """
    c = F.regexp_replace(html, _GONE, " ")
    c = F.regexp_replace(F.regexp_replace(c, _BREAKS, "\n"), _TAG, "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r" ?\n ?", "\n"), r"\n+", "\n"), F.lit(" \n"))
