"""The triage of a pool: cheap scan of all, deep looks within a budget, a ranked list with its evidence, metrics."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SamplerConfig
from ..kernels.signal import Geometry, detect_period
from ..operators import metrics, scan
from ..sources.pools import write_document, write_rows, write_text
from ..sources.scratch import written

PRESETS = {"spikes": 1, "segments": 25}
DEEP = "series_id string, deep_score double, period int, sigma double, reach double, evidence array<struct<start:bigint,end:bigint,z:double>>"


def deep_detect(points: DataFrame, preset: str = "segments", top: int = 3) -> DataFrame:
    """deep_score, diagnostics and evidence of each series: its residual above the baseline, averaged over windows of the preset's width.

    deep_score is the farthest window in units of the residual's spread, evidence the top windows that don't overlap.
    """
    width = PRESETS[preset]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("time_index")["value"].to_numpy()
        period = detect_period(x, SamplerConfig())
        g = Geometry(x, period)
        w = min(width, len(x))
        sums = np.concatenate([[0.0], np.cumsum(g.residual - np.median(g.residual))])
        z = np.abs(sums[w:] - sums[:-w]) / (np.sqrt(w) * g.sigma)
        found, open_ = [], z.copy()
        for _ in range(min(top, len(z))):
            i = int(np.argmax(open_))
            if open_[i] <= 0:
                break
            found.append({"start": i, "end": i + w, "z": round(float(z[i]), 6)})
            open_[max(0, i - w + 1) : i + w] = 0
        row = {"series_id": pdf["series_id"].iloc[0], "deep_score": float(z.max()), "period": period, "sigma": g.sigma, "reach": g.reach, "evidence": found}
        return pd.DataFrame([row]).astype({"period": "Int32"})

    return points.select("series_id", "time_index", "value").groupBy("series_id").applyInPandas(one, DEEP)


def triage(points: DataFrame, budget: int = 50, preset: str = "segments") -> dict[str, DataFrame]:
    """cheap_scan, deep_detect, ranked_list and decision_trace of a pool, for a budget of deep looks per thousand series.

    The final score is the sum of log(1 + score) of both looks; a series without a deep look has its cheap one alone.
    Each decision names the fields it rests on. tool_calls has the calls of each tool and the milliseconds it took.
    """
    began = time.perf_counter()
    cheap = written(scan.cheap_scan(points), "cheap-scan")
    scanned = time.perf_counter()
    chosen = written(scan.budget_topk(cheap, budget), "chosen")
    deep = written(deep_detect(points.join(chosen.select("series_id"), "series_id", "left_semi"), preset), "deep")
    looked = time.perf_counter()
    calls = [("cheap_scan", cheap.count(), 1000 * (scanned - began)), ("deep_detect", deep.count(), 1000 * (looked - scanned))]
    both = cheap.join(deep.select("series_id", "deep_score"), "series_id", "left")
    final = both.withColumn("final_score", F.log1p("cheap_score") + F.coalesce(F.log1p("deep_score"), F.lit(0.0)))
    ranked = scan.ranked_list(final.select("series_id", "final_score"))
    why = F.format_string("cheap_scan.cheap_score=%.4f is among the best for the budget; deep_detect.deep_score=%.4f over %d windows", "cheap_score", "deep_score", F.size("evidence"))
    trace = deep.join(chosen.select("series_id", "cheap_score"), "series_id").select("series_id", "cheap_score", "deep_score", "evidence", why.alias("reason"))
    return {"cheap_scan": cheap.drop("y_i"), "deep_detect": deep, "ranked_list": ranked, "decision_trace": trace, "tool_calls": points.sparkSession.createDataFrame(calls, "tool string, calls bigint, ms double"), "_truth": cheap.select("series_id", "y_i")}


def evaluate(found: dict[str, DataFrame]) -> dict[str, float]:
    """AUROC of the final scores, adjusted Rand index of what is reported, calls of each tool and the seconds of both."""
    judged = found["ranked_list"].join(found["_truth"], "series_id").withColumn("predicted", F.col("is_reported").cast("int"))
    calls = {r["tool"]: r for r in found["tool_calls"].collect()}  # a row a tool
    scores = {"auroc": metrics.auroc(judged, "final_score").first()[0], "ari": metrics.adjusted_rand(judged).first()[0]}
    return {**scores, "cheap_calls": calls["cheap_scan"]["calls"], "deep_calls": calls["deep_detect"]["calls"], "seconds": round(sum(r["ms"] for r in calls.values()) / 1000, 3)}


def summary(scores: dict[str, float]) -> str:
    """The run as a table in Markdown; what can't be computed is a dash."""
    cell = lambda v: "-" if v is None else f"{v:,.4f}" if isinstance(v, float) else f"{v:,}"
    return "\n".join(["# Run", "", "| measure | value |", "|---|---|", *(f"| {k} | {cell(v)} |" for k, v in scores.items())])


def write_run(found: dict[str, DataFrame], root: str) -> None:
    """The four tables as JSON lines, metrics.json, and summary.md."""
    for name in ("cheap_scan", "deep_detect", "ranked_list", "decision_trace"):
        write_rows(found[name], f"{root}/{name}.json")
    spark, scores = found["ranked_list"].sparkSession, evaluate(found)
    write_document(spark, scores, f"{root}/metrics.json")
    write_text(spark, summary(scores), f"{root}/summary.md")
