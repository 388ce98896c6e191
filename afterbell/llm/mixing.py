"""Operator 4: mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afterbell.llm.common import materialize

NONE = "(none)"
#: Topics and the words or forms that speak for them, in lower case.
TOPICS = (
    ("legal", "licens|copyright|warrant|liabilit|permission|rights reserved"),
    ("contact", "@[a-z0-9-]+[.]|[0-9]{3}[ )-]+[0-9]{3}"),
    ("credentials", "password|passwd|secret|token|api_?key|akia[a-z0-9]+"),
    ("table", " [|] "),
    ("noise", "[#$%&*]{3}|!!"),
)
#: Words to which one such hit has to come at least, or the topic is ``prose``.
WORDS_PER_HIT = 100
WORD = "[^\\x20\\x09-\\x0D]+"


def with_topic(docs: DataFrame, text_col: str = "text", tokens: str = "_tokens", topic: str = "_topic") -> DataFrame:
    """``docs`` with the number of words and the topic with most hits in the whole text, the first of equals; ``prose`` if none has one in ``WORDS_PER_HIT`` words.

    What is used several times is a column of its own first, or it would be worked out several times.
    """
    low = docs.withColumns({tokens: tokens_column(text_col), "_afterbell_low": F.lower(F.coalesce(F.col(text_col), F.lit("")))})
    hits = F.array(*[F.struct(F.regexp_count("_afterbell_low", F.lit(p)).alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, (t, p) in enumerate(TOPICS)])
    best = low.withColumn("_afterbell_best", F.array_max(hits)).drop("_afterbell_low")
    enough = (F.col("_afterbell_best.n") > 0) & (F.col("_afterbell_best.n") * WORDS_PER_HIT >= F.col(tokens))
    return best.withColumn(topic, F.when(enough, F.col("_afterbell_best.t")).otherwise("prose")).drop("_afterbell_best")


def tokens_column(text_col: str = "text") -> F.Column:
    """Words of the whole text: runs between white space."""
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def tempered(totals: Mapping[str, float], temperature: float) -> dict[str, float]:
    """Shares in proportion to totals to the power ``temperature``: 1 keeps them, 0 makes all equal."""
    powers = {k: v**temperature for k, v in totals.items() if v > 0}
    whole = sum(powers.values())
    return {k: v / whole for k, v in powers.items()}


def rake(tokens: np.ndarray, groups: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Factor of each cell, so that factor * tokens meets every marginal's target shares.

    tokens: of each cell. groups: for each marginal the group number of each cell. targets: for each
    marginal the target share of each group. Cells without tokens keep factor 1.
    """
    weights = tokens / tokens.sum() if tokens.sum() else tokens.astype(float)
    start = weights.copy()
    for _ in range(rounds):
        worst = 0.0
        for group, target in zip(groups, targets, strict=True):
            now = np.bincount(group, weights, len(target))
            ratio = np.divide(target, now, out=np.ones_like(target), where=now > 0)
            worst = max(worst, float(np.abs(now - target)[now > 0].max(initial=0)))
            weights = weights * ratio[group]
        if worst < tolerance:
            break
    return np.divide(weights, start, out=np.ones_like(weights), where=start > 0)


def calibrate(tokens: np.ndarray, factor: np.ndarray, share: float | None) -> np.ndarray:
    """Probabilities min(1, scale * factor): scale 1 over the largest factor, or so that ``share`` of the tokens is expected. Cells without tokens have 1."""
    live = tokens > 0
    most = factor[live].max(initial=0)
    if not most:
        return np.ones(len(tokens)) if not live.any() else np.where(live, 0.0, 1.0)
    scale = 1 / most
    if share is not None:
        low, high = 0.0, 1 / factor[live & (factor > 0)].min()
        for _ in range(200):
            scale = (low + high) / 2
            enough = (tokens * np.minimum(1, scale * factor)).sum() >= share * tokens.sum()
            low, high = (low, scale) if enough else (scale, high)
    return np.where(live, np.minimum(1, scale * factor), 1.0)


def fit_mixture(
    docs: DataFrame,
    dims: Mapping[str, F.Column],
    tokens: F.Column,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    temperature: float = 0.7,
    share: float | None = None,
    max_cells: int = 100_000,
) -> DataFrame:
    """One row per cell of the dimensions: its tokens, factor and sampling probability.

    Token totals of all documents are summed by cell with map-side sums. The cells are raked to the
    targets: given shares by dimension and value, or the corpus' own shares tempered. Up to
    ``max_cells`` this is done at once, more are raked as a table (:func:`rake_table`), to the same end.
    The probability is the factor over the largest factor, so no cell needs more than all its documents
    and the expected token shares are the raked ones. With ``share`` it is calibrated so that this share
    of all tokens is expected: cells that would need more than all their documents are taken whole, and
    the factors of the others are scaled up to make good for them.
    """
    names = list(dims)
    summed = (
        docs.select(*[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in dims.items()], tokens.alias("_tokens"))
        .groupBy(*names)
        .agg(F.sum("_tokens").alias("cell_tokens"), F.count("*").alias("cell_docs"))
    )
    summed = materialize(summed, "cells")
    if summed.count() > max_cells:
        return rake_table(summed, names, targets or {}, temperature, share)
    cells = summed.orderBy(*names).collect()
    total = np.array([c.cell_tokens for c in cells], float)
    groups, shares = [], []
    for n in names:
        values = sorted({c[n] for c in cells})
        index = {v: i for i, v in enumerate(values)}
        group = np.array([index[c[n]] for c in cells], int)
        sums = np.bincount(group, total, len(values)) if len(cells) else np.zeros(0)
        wanted = dict((targets or {}).get(n) or tempered(dict(zip(values, sums, strict=True)), temperature))
        target = np.array([wanted.get(v, 0.0) if s > 0 else 0.0 for v, s in zip(values, sums, strict=True)])
        groups.append(group)
        shares.append(target / target.sum() if target.sum() else target)
    factor = rake(total, groups, shares) if len(cells) else np.zeros(0)
    probability = calibrate(total, factor, share)
    rows = [(*[c[n] for n in names], c.cell_tokens, c.cell_docs, float(f), float(p)) for c, f, p in zip(cells, factor, probability, strict=True)]
    schema = ", ".join(f"{n} string" for n in names) + ", cell_tokens long, cell_docs long, factor double, probability double"
    return F.broadcast(docs.sparkSession.createDataFrame(rows, schema))  # max_cells short rows at most


def rake_table(
    cells: DataFrame, names: list[str], targets: Mapping[str, Mapping[str, float]], temperature: float, share: float | None, rounds: int = 200, tolerance: float = 1e-9
) -> DataFrame:
    """What :func:`rake` and :func:`calibrate` do, for more cells than the driver should hold: marginals are aggregations and joins, each round a table."""
    spark = cells.sparkSession
    whole = float(cells.agg(F.sum("cell_tokens")).first()[0] or 0)
    now = cells.withColumn("_w", F.col("cell_tokens") / F.lit(whole or 1.0))
    for n in names:
        sums = cells.groupBy(n).agg(F.sum("cell_tokens").alias("_s")).where("_s > 0")
        if targets.get(n):
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[n].items()], f"{n} string, _p double")
            sums = sums.join(given, n, "left").withColumn("_p", F.coalesce("_p", F.lit(0.0)))
        else:
            sums = sums.withColumn("_p", F.pow(F.col("_s").cast("double"), F.lit(temperature)))
        total = float(sums.agg(F.sum("_p")).first()[0] or 0)
        now = now.join(sums.select(n, (F.col("_p") / F.lit(total or 1.0)).alias(f"_target{n}")), n, "left").fillna(0.0, [f"_target{n}"])
    for _ in range(rounds):
        worst = 0.0
        for n in names:
            sums = now.groupBy(n, f"_target{n}").agg(F.sum("_w").alias("_now"))
            worst = max(worst, sums.where("_now > 0").agg(F.max(F.abs(F.col("_now") - F.col(f"_target{n}")))).first()[0] or 0.0)
            ratio = F.when(F.col("_now") > 0, F.col(f"_target{n}") / F.col("_now")).otherwise(1.0)
            now = now.join(sums.select(n, ratio.alias("_ratio")), n).withColumn("_w", F.col("_w") * F.col("_ratio")).drop("_ratio")
            now = materialize(now, "raking")
        if worst < tolerance:
            break
    live = F.col("cell_tokens") > 0
    now = now.withColumn("factor", F.when(live, F.col("_w") * F.lit(whole) / F.col("cell_tokens")).otherwise(1.0))
    edges = now.where(live).agg(F.max("factor").alias("most"), F.min(F.when(F.col("factor") > 0, F.col("factor"))).alias("least")).first()
    scale = 1 / edges.most if edges.most else 0.0
    if share is not None and edges.least:
        low, high = 0.0, 1 / edges.least
        for _ in range(60):
            scale = (low + high) / 2
            got = now.where(live).agg(F.sum(F.col("cell_tokens") * F.least(F.lit(1.0), F.col("factor") * scale))).first()[0]
            low, high = (low, scale) if got >= share * whole else (scale, high)
    return now.select(*names, "cell_tokens", "cell_docs", "factor", F.when(live, F.least(F.lit(1.0), F.col("factor") * scale)).otherwise(1.0).alias("probability"))


def _chance(id_col: str, text_col: str, seed: int) -> F.Column:
    """A number in [0, 1) that id and text decide: the first 13 digits of an MD5 in base 16."""
    said = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    targets: Mapping[str, Mapping[str, float]] | None = None,
    temperature: float = 0.7,
    share: float | None = None,
    seed: int = 7,
    max_cells: int = 100_000,
) -> DataFrame:
    """Every document's cell, calibrated probability and whether it is sampled.

    ``targets`` has token shares by dimension (source, lang, topic) and value; dimensions without
    are tempered shares of the corpus. Returns ``id_col``, source, lang, topic, n_tokens, factor,
    probability, selected. Defined cases: nulls in a dimension are the value ``(none)``; documents
    without words have probability 1; a value with target 0 or without target is never sampled;
    equal rows share their fate; an empty table gives an empty result; further columns are ignored.
    """
    wanted = {f"_{k}": v for k, v in (targets or {}).items()}
    dims = ["_source", "_lang", "_topic"]
    # texts are read once; what is needed of them is small
    named = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    rows = with_topic(named, "_text", "n_tokens").select(
        "_id", *[F.coalesce(F.col(n).cast("string"), F.lit(NONE)).alias(n) for n in dims], "n_tokens", _chance("_id", "_text", seed).alias("_chance")
    )
    rows = materialize(rows, "mixture")
    cells = fit_mixture(rows, {n: F.col(n) for n in dims}, F.col("n_tokens"), wanted, temperature, share, max_cells)
    mixed = rows.join(cells, dims)
    probability = F.when(F.col("n_tokens") > 0, F.col("probability")).otherwise(1.0)
    return mixed.select(
        F.col("_id").alias(id_col),
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        "n_tokens",
        "factor",
        probability.alias("probability"),
        (F.col("_chance") < probability).alias("selected"),
    )


def sample_mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    targets: Mapping[str, Mapping[str, float]] | None = None,
    temperature: float = 0.7,
    share: float | None = None,
    seed: int = 7,
    max_cells: int = 100_000,
) -> DataFrame:
    """The sampled rows of ``docs``, all columns: the same choice as :func:`mix_documents`, without a shuffle of texts."""
    wanted = {f"_{k}": v for k, v in (targets or {}).items()}
    dims = {"_source": F.col(source_col), "_lang": F.col(lang_col), "_topic": F.col("_afterbell_topic")}
    told = with_topic(docs, text_col, "_afterbell_tokens", "_afterbell_topic")
    cells = fit_mixture(told, dims, F.col("_afterbell_tokens"), wanted, temperature, share, max_cells)
    cells = cells.select(*[F.col(n).alias(f"_afterbell{n}") if n != "_topic" else F.col(n).alias("_afterbell_cell_topic") for n in dims], F.col("probability").alias("_afterbell_probability"))
    names = {"_source": "_afterbell_source", "_lang": "_afterbell_lang", "_topic": "_afterbell_cell_topic"}
    same = [F.coalesce(c.cast("string"), F.lit(NONE)) == F.col(names[n]) for n, c in dims.items()]
    chosen = (F.col("_afterbell_tokens") == 0) | (_chance(id_col, text_col, seed) < F.col("_afterbell_probability"))
    return told.join(cells, same[0] & same[1] & same[2]).where(chosen).select(*[F.col(f"`{c}`") for c in docs.columns])
