"""Compositions: documents to reviewed event rows, events to a study with controls and backtest. Parts stay lazy, but for what several of them read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afterbell.operators import backtest as B
from afterbell.operators import evidence as E
from afterbell.operators import projections as P
from afterbell.operators import review as R
from afterbell.operators import study as S
from afterbell.sources.shared import written


@dataclass(frozen=True)
class RulePack:
    """A plug-in for a domain: its rules, the fields of its event rows and its threshold for claims."""

    name: str
    rules: Sequence[E.Rule]
    threshold: float = 0.8
    required: Sequence[str] = field(default_factory=tuple)

    @property
    def fields(self) -> list[str]:
        return sorted({r.field for r in self.rules})


def evidence_pipeline(docs: DataFrame, pack: RulePack, reviews: DataFrame | None = None) -> dict[str, DataFrame]:
    """Documents (doc_id, event_id, text) through a rule pack: matches, claims, queue, coverage, quality and event rows.

    reviews: claim_id and review_status of people; blank statuses change nothing.
    """
    matches = E.match_rules(docs, pack.rules)
    events = docs.select(F.col("doc_id").alias("source_doc_id"), "event_id")
    claims = E.claims_of(matches).join(events, "source_doc_id").withColumn("review_status", F.lit("unreviewed"))
    if reviews is not None:
        claims = R.override_non_blank(claims, reviews, "claim_id", ["review_status"])
    queue = R.claim_queue(claims, claims.select("evidence_span_id", "source_doc_id", "claim_id", "evidence_text"), pack.threshold)
    return {
        "matches": matches, "claims": claims, "queue": queue, "coverage": R.field_coverage(queue), "quality": R.quality_report(queue),
        "events": R.event_rows(docs.select("event_id", "doc_id"), queue, pack.fields),
    }


def study_pipeline(events: DataFrame, returns: DataFrame, benchmark: DataFrame, bars: DataFrame, by: Sequence[str] = ("event_type",), least: int = 5) -> dict[str, DataFrame]:
    """Events through the study, base rates, robustness, and the same study on placebo and peer controls.

    The market rows are written once; the main study and both controls read them.
    """
    market = written(S.market_rows(returns, benchmark), "market")
    study = written(S.event_study(events, market), "study")
    placebos = B.random_placebos(events, B.free_days(bars, events)).select("event_id", "ticker", F.col("placebo_day").cast("timestamp").alias("event_time"), "event_type", F.lit("before_open").alias("release_session"))
    peers = B.peer_controls(events, B.ring_peers(bars.select("ticker"))).withColumn("release_session", F.lit("before_open"))
    controls = S.event_study(placebos, market).unionByName(S.event_study(peers, market)).withColumn("control", F.col("event_type"))
    ok = study.where("status = 'ok' and car_3 is not null")
    return {
        "study": study, "base_rates": S.base_rates(study, list(by), least=least), "winsorised": S.winsorised_mean(ok, "car_3", list(by)), "concentration": S.concentration(ok, "car_3", "ticker"),
        "controls": controls,
    }


def falsification_pass(study: DataFrame, controls: DataFrame, preds: DataFrame, keys: Sequence[str] = ("event_type",), horizon: int = 3, iterations: int = 500, least: int = 20) -> dict[str, DataFrame]:
    """What tries to refute an effect: controls, shuffled returns, single tickers and costs, and one row of gates.

    study and controls: event studies (controls with ``control``). preds: event_id, p, ret, the keys and reaction_start.
    Gates: enough events, every control kind tells them apart, the shuffles' p-value below .05 for some key,
    no ticker with over half of the absolute return, and the mean net return stays above 0 at 50 basis points.
    """
    car = f"car_{horizon}"
    ok = study.where((F.col("status") == "ok") & F.col(car).isNotNull())
    against = P.compare_controls(ok, controls.where("status = 'ok'"), car, least)
    null = B.null_shuffle(preds, "p", "ret", "event_id", list(keys), iterations)
    shares = S.concentration(ok, car, "ticker")
    costs = B.cost_grid(preds, "p", "ret", list(keys), ["reaction_start", "event_id"])
    one = lambda df, c: df.agg(c.alias("x")).withColumnRenamed("x", "gate")
    gates = {
        "enough_events": one(ok, F.count("*") >= least),
        "controls_differ": one(against, F.coalesce(F.bool_and(F.col("verdict") == "distinct"), F.lit(False))),
        "shuffles_differ": one(null, F.coalesce(F.min("p_value") < 0.05, F.lit(False))),
        "no_single_ticker": one(shares, F.coalesce(F.max("share") <= 0.5, F.lit(False))),
        "survives_costs": one(costs.where("cost_bps = 50"), F.coalesce(F.max("mean_net") > 0, F.lit(False))),
    }
    rows = [df.select(F.lit(name).alias("name"), F.col("gate").alias("passed")) for name, df in gates.items()]
    table = rows[0]
    for r in rows[1:]:
        table = table.unionAll(r)
    return {"controls": against, "null": null, "concentration": shares, "costs": costs, "gates": table}


def falsification_report(parts: dict[str, DataFrame], title: str = "Falsification", most: int = 20) -> str:
    """Markdown of a falsification pass: gates, controls, shuffles, costs and the ``most`` largest shares."""
    columns = {
        "gates": ("name", "passed"), "controls": ("control", "control_n", "control_mean", "n", "mean", "verdict"), "null": ("n", "actual", "null_mean", "z", "p_value"),
        "costs": ("cost_bps", "trades", "mean_net", "hit_rate", "max_drawdown"), "concentration": ("ticker", "n", "total", "share", "warning"),
    }
    lines = [f"# {title}"]
    for name, shown in columns.items():
        df = parts[name]
        own = [c for c in df.columns if c not in shown and c == "event_type"] + list(shown)
        rows = df.orderBy(F.desc("share") if name == "concentration" else own[0]).limit(most).collect()
        said = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
        lines += ["", f"## {name}", "", "| " + " | ".join(own) + " |", "|" + "-|" * len(own), *["| " + " | ".join(said(r[c]) for c in own) + " |" for r in rows]]
    return "\n".join(lines) + "\n"
