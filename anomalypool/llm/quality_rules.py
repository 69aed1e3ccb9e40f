"""Quality rules: a decision list learned by sequential covering, spoken as ordered Spark conditions."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_stats
from .common import free_name
from .text_stats import COUNTS, RATIOS

MAX_LABELLED = 20_000  # labelled texts to learn from, at most
CUTS = 64  # thresholds tried for a statistic
MIN_PRECISION = 0.98  # of a rule, on the third of the rows kept for pruning
MIN_COVERED = 3  # rows that a rule must reject there
MAX_TERMS, MAX_RULES = 4, 24
STATISTICS = tuple(n for n in RATIOS if n != "distinct_ratio")  # that one falls with length, whatever the quality


@dataclass(frozen=True)
class Term:
    statistic: str
    at_least: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, list(RATIOS).index(self.statistic)]
        return column >= self.threshold if self.at_least else column < self.threshold

    def column(self, counts: str) -> Column:
        value = text_stats.ratio(counts, self.statistic)
        return value >= self.threshold if self.at_least else value < self.threshold


Rule = tuple[Term, ...]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for term in rule:
        out &= term.holds(x)
    return out


def _cuts(values: np.ndarray) -> np.ndarray:
    """Thresholds midway between neighbours, at CUTS quantiles at most."""
    distinct = np.unique(values)
    between = (distinct[1:] + distinct[:-1]) / 2
    return between if len(between) <= CUTS else np.unique(np.quantile(between, np.linspace(0, 1, CUTS)))


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the term of most information gain until no good row is covered."""
    rule: Rule = ()
    while len(rule) < MAX_TERMS:
        p, n = int(bad.sum()), int((~bad).sum())
        if not p or not n:
            break
        base, best, found = math.log2(p / (p + n)), 0.0, None
        for name in STATISTICS:
            j = list(RATIOS).index(name)
            for cut in _cuts(x[:, j]):
                above = x[:, j] >= cut
                for side in (True, False):
                    covered = above if side else ~above
                    p1, all1 = int((covered & bad).sum()), int(covered.sum())
                    if p1 and (gain := p1 * (math.log2(p1 / all1) - base)) > best + 1e-12:
                        best, found = gain, Term(name, side, float(cut))
        if found is None:
            break
        rule = (*rule, found)
        inside = found.holds(x)
        x, bad = x[inside], bad[inside]
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule with the best (p - n) / (p + n) on rows it was not grown on; the shortest of equals."""
    def worth(r: Rule) -> float:
        covered = _holds(r, x)
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn(ids: list[int], x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Sequential covering: grow a rule on two thirds of the rows, prune it on the rest, take it if it is precise there, drop what it covers."""
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 0 for i in ids], dtype=bool)
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and bad[~held].any():
        rule = _prune(_grow(x[~held], bad[~held]), x[held], bad[held])
        covered = _holds(rule, x) if rule else np.zeros(len(x), dtype=bool)
        p, n = int((covered & held & bad).sum()), int((covered & held & ~bad).sum())
        if p < MIN_COVERED or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        ids, x, bad, held = [i for i, c in zip(ids, covered) if not c], x[~covered], bad[~covered], held[~covered]
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = MAX_LABELLED) -> list[Rule]:
    """Rules that reject texts like those labelled 0, from at most bound labelled texts. No labels give no rules."""
    found = text_stats.labelled_counts(docs, labels, label, bound, id_col, text_col).select("_id", "_label", "_counts.*").toPandas().sort_values("_id")
    if found.empty:
        return []
    return learn(found["_id"].tolist(), text_stats.ratio_matrix(found[list(COUNTS)].to_numpy()), found["_label"].to_numpy() < 1)


def verdict(rules: list[Rule], counts: str) -> Column:
    """The number of the first rule that rejects, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        every = rule[0].column(counts)
        for term in rule[1:]:
            every = every & term.column(counts)
        out = F.when(every, k) if out is None else out.when(every, k)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed(counts: str) -> Column:
    c = F.col(counts)
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> tuple[DataFrame, str, Column, Column]:
    """docs with a struct of counts, that column's name, and two conditions on it: base_failed and the number of the rule that rejects."""
    name = free_name(docs, "_counts")
    judged = text_stats.with_counts(docs, text_col, name)
    return judged, name, base_failed(name), verdict(rules, name)


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule: one row per row of docs.

    kept is false where base_failed or a learned rule rejects; rule is that rule's number, else 0. Null texts count
    as empty, without words, and fail the base. One pass over the texts, without a shuffle, after the learning.
    """
    judged, name, failed, rule = judge(docs.select(F.col(id_col), F.col(text_col)), learn_rules(docs, labels, id_col=id_col, text_col=text_col), text_col)
    own = judged.select(F.col(id_col), *(F.col(name)[c].alias(c) for c in COUNTS[:5]), failed.alias("base_failed"), rule.alias("rule"))
    return own.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that quality_verdicts keeps, with all their columns."""
    judged, _, failed, rule = judge(docs, learn_rules(docs, labels, id_col=id_col, text_col=text_col), text_col)
    return judged.filter(~failed & (rule == 0)).select(*docs.columns)
