"""Weak supervision on vote patterns: expectation-maximisation over counted votes.

A labeler votes 1 (for), 0 (against) or null (abstains). Rows with equal votes
are counted first, by DataFrame aggregation, so expectation-maximisation sees at
most ``3 ** n_labelers`` patterns however large the corpus is, and runs on those
counts alone.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Votes = tuple[int | None, ...]


@dataclass(frozen=True)
class VoteModel:
    """Class prior and, per labeler, P(votes 1 | class 1) and P(votes 0 | class 0); whether the estimate settled."""

    prior: float
    sensitivity: tuple[float, ...]
    specificity: tuple[float, ...]
    converged: bool = True

    def weights(self) -> list[tuple[float, float]]:
        """Log odds that a vote of 1 and a vote of 0 of each labeler adds."""
        return [(math.log(a / (1 - b)), math.log((1 - a) / b)) for a, b in zip(self.sensitivity, self.specificity, strict=True)]

    def posterior(self, votes: Column) -> Column:
        """P(class 1 | votes) of an array of votes; abstentions carry no evidence."""
        weights = F.array(*[F.struct(F.lit(x).alias("yes"), F.lit(y).alias("no")) for x, y in self.weights()])
        evidence = F.zip_with(votes, weights, lambda v, w: F.coalesce(F.when(v == 1, w["yes"]).when(v == 0, w["no"]), F.lit(0.0)))
        log_odds = F.aggregate(evidence, F.lit(math.log(self.prior / (1 - self.prior))), lambda a, x: a + x)
        return 1 / (1 + F.exp(-log_odds))

    def of(self, votes: Votes) -> float:
        """P(class 1 | votes)."""
        odds = math.log(self.prior / (1 - self.prior)) + sum(w[0] if v == 1 else w[1] for v, w in zip(votes, self.weights(), strict=True) if v is not None)
        return 1 / (1 + math.exp(-odds))


def fit_counts(counts: dict[Votes, float], n_labelers: int, prior: float = 0.7, rounds: int = 500, start: float = 0.8, floor: float = 0.55, smoothing: float = 2.0, tolerance: float = 1e-6) -> VoteModel:
    """Estimate a :class:`VoteModel` from the number of rows of each vote pattern.

    ``floor`` keeps every labeler better than chance, which fixes which class is
    which. Without rows the starting model returns. If ``rounds`` rounds do not
    settle to ``tolerance``, the model says so and a warning is given.
    """
    model = VoteModel(prior, (start,) * n_labelers, (start,) * n_labelers)
    total = sum(counts.values())
    if not total:
        return model
    clamp = lambda x, low, high: min(high, max(low, x))
    for _ in range(rounds):
        good = {v: n * model.of(v) for v, n in counts.items()}
        sens, spec = [], []
        for k in range(n_labelers):
            yes = [v for v in counts if v[k] == 1]
            no = [v for v in counts if v[k] == 0]
            yes_good, no_good = sum(good[v] for v in yes), sum(good[v] for v in no)
            yes_bad, no_bad = sum(counts[v] for v in yes) - yes_good, sum(counts[v] for v in no) - no_good
            sens.append(clamp((yes_good + smoothing * start) / (yes_good + no_good + smoothing), floor, 0.99))
            spec.append(clamp((no_bad + smoothing * start) / (yes_bad + no_bad + smoothing), floor, 0.99))
        new = VoteModel(clamp(sum(good.values()) / total, 0.02, 0.98), tuple(sens), tuple(spec))
        moved = max(abs(a - b) for a, b in zip((new.prior, *sens, *spec), (model.prior, *model.sensitivity, *model.specificity), strict=True))
        model = new
        if moved < tolerance:
            return model
    warnings.warn(f"expectation-maximisation did not settle in {rounds} rounds (last step {moved:.2g})", stacklevel=2)
    return VoteModel(model.prior, model.sensitivity, model.specificity, converged=False)


def fit_votes(patterns: DataFrame, n_labelers: int, **options) -> VoteModel:
    """:func:`fit_counts` of ``patterns``: distinct ``votes`` arrays and their count ``n``, 3 ** n_labelers rows at most."""
    return fit_counts({tuple(r["votes"]): r["n"] for r in patterns.groupBy("votes").agg(F.sum("n").alias("n")).collect()}, n_labelers, **options)
