"""Operator 3: language of whole texts, family first, then one-versus-one linear support vector machines."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from afterbell.llm.common import in_parts, materialize

UNKNOWN = "und"
#: Features: byte trigrams of lower-cased letters, hashed into so many counts.
DIMENSIONS = 8192
#: Closely related languages by family; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "sa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_LETTER = regex.compile(r"\p{L}")
#: Letters and bytes of letters outside ASCII stay, everything else is a space.
_KEEP = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed trigram counts; trigrams of spaces don't count."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_KEEP) + b" ", np.uint8).astype(np.uint32)
    hashed = (data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA6B) + data[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(19)
    hashed = hashed[~((data[1:-1] == 32) & ((data[:-2] == 32) | (data[2:] == 32)))]
    x = np.sqrt(np.bincount(hashed, minlength=DIMENSIONS).astype(np.float32))
    norm = np.linalg.norm(x)
    return x / norm if norm else x


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def train_svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine with squared hinge loss; y is -1 or 1, both sides weigh the same.

    Accelerated gradient steps on the whole (bounded) sample.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step, t = 1 / (4 + strength), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (strength * v - 2 * x.T @ (weight * y * slack))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


class LanguageModel:
    """Families told apart one against the rest, languages of a family one against one."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.langs = sorted(set(labels))
        family = [FAMILY_OF.get(lang, lang) for lang in labels]
        self.families = sorted(set(family))
        self.members = {f: [lang for lang in self.langs if FAMILY_OF.get(lang, lang) == f] for f in self.families}
        named, family = np.array(labels), np.array(family)
        rows = []
        if len(self.families) > 1:
            rows += [train_svm(x, np.where(family == f, 1, -1).astype(np.float32)) for f in self.families]
        self.pairs = {f: list(combinations(self.members[f], 2)) for f in self.families}
        for f in self.families:
            for a, b in self.pairs[f]:
                both = (named == a) | (named == b)
                rows.append(train_svm(x[both], np.where(named[both] == a, 1, -1).astype(np.float32)))
        self.weights = np.array(rows, np.float32) if rows else np.zeros((0, DIMENSIONS + 1), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and a score from 0 to 1: the family's share times the weakest duel the language won in it."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        margin = self.weights[:, :-1] @ features(text) + self.weights[:, -1]
        sure = 1 / (1 + np.exp(-4 * np.clip(margin, -8, 8).astype(np.float64)))
        family, share, at = self.families[0], 1.0, 0
        if len(self.families) > 1:
            at = len(self.families)
            best = int(np.argmax(margin[:at]))
            family, share = self.families[best], float(sure[best] / sure[:at].sum())
        for f in self.families:
            if f == family:
                break
            at += len(self.pairs[f])
        votes = dict.fromkeys(self.members[family], 0)
        duels = {lang: [1.0] for lang in votes}
        for k, (a, b) in enumerate(self.pairs[family]):
            p = float(sure[at + k])
            votes[a if p >= 0.5 else b] += 1
            duels[a].append(p)
            duels[b].append(1 - p)
        lang = max(votes, key=lambda x: (votes[x], min(duels[x]), x))
        return lang, min(1.0, max(0.0, share * min(duels[lang])))


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shares(wanted: dict[str, int], total: int) -> dict[str, int]:
    """Parts of ``total``: what each wants, where that is no more than an equal part of what those who want less leave over."""
    out = {}
    for k, name in enumerate(sorted(wanted, key=lambda x: (wanted[x], x))):
        out[name] = min(wanted[name], total // (len(wanted) - k))
        total -= out[name]
    return out


def learn_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, max_chars: int = 20_000_000, max_languages: int = 500
) -> LanguageModel:
    """Fit on at most ``per_language`` labelled texts of each of the ``max_languages`` most frequent labels, and ``max_chars`` characters in all.

    Texts are whole, without a held-out id, and taken by the hash of id and text, so that a repeated row counts
    once. Rows whose hash is too large to be among the first of their label are left out before any are
    sorted. If the rows have more than ``max_chars`` characters, each language has a share of its own
    (:func:`shares`); a text that doesn't fit into what is left of it is passed over, and doesn't count.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    learn = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id") & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    learn = learn.withColumn("hash", F.xxhash64("id", "text"))
    counts = learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return LanguageModel(np.zeros((0, DIMENSIONS), np.float32), [])
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, float(min(1.0, 4 * per_language / r["count"])))])
    some = learn.where(F.pmod("hash", F.lit(1 << 40)) < F.try_element_at(rates, F.col("lang")) * float(1 << 40)).dropDuplicates(["lang", "hash"])
    some = materialize(some.select("lang", "hash", "text", F.length("text").alias("chars")), "language-sample")
    order = Window.partitionBy("lang").orderBy("hash")
    ranked = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language)
    wanted = {r.lang: int(r.chars) for r in ranked.groupBy("lang").agg(F.sum("chars").alias("chars")).collect()}
    left = shares(wanted, max_chars)
    x, labels = [], []
    for row in ranked.where(F.col("chars") <= max(left.values(), default=0)).select("lang", "text", "hash").orderBy("hash", "lang").toLocalIterator():
        if len(row.text) <= left.get(row.lang, 0):
            left[row.lang] -= len(row.text)
            x.append(features(row.text))
            labels.append(row.lang)
    return LanguageModel(np.array(x, np.float32).reshape(-1, DIMENSIONS), labels)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, lang_pred and score of every whole text; ``und`` with score 0 for a text that is null or without letters.

    Defined cases: with nothing learned every prediction is ``und``; null ids aren't held out;
    repeated rows give repeated results; an empty table gives an empty result; further columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            found = [shared.value.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {id_type}, held_out boolean, lang_pred string, score double").withColumnRenamed("_id", id_col)


def keep_known_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language, all columns; a missing ``lang_col`` is filled with the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            found = [shared.value.predict(t)[0] for t in batch.column(text_at).to_pylist()]
            named = [old if old is not None else new for old, new in zip(batch.column(lang_at).to_pylist(), found, strict=True)]
            columns = list(batch.columns)
            columns[lang_at] = pa.array(named, columns[lang_at].type)
            kept = pa.array([f != UNKNOWN for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(kept)

    return docs.mapInArrow(run, docs.schema)
