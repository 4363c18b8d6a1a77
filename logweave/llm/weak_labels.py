"""Weak supervision: accuracies of voters that may abstain, by expectation maximisation.

Voters say 1 (good), -1 (bad) or 0 (abstain). The corpus is reduced to the counts of its vote patterns; there are at most
3 ** voters of them whatever the corpus, and every row counts. The two-class model has, for each voter and class, the
chances of its three votes; expectation maximisation runs over the pattern table on the driver.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More voters would let the pattern table outgrow a driver: 3 ** 12 is half a million rows.
MOST_VOTERS = 12


@dataclass(frozen=True)
class VoterModel:
    prior: float
    #: log chances [class: bad, good][voter][vote + 1]
    logs: tuple

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of good for each row of votes (-1, 0, 1)."""
        logs, at = np.array(self.logs), np.arange(votes.shape[1])
        side = [np.log(p) + logs[c][at[None, :], votes + 1].sum(1) for c, p in ((0, 1 - self.prior), (1, self.prior))]
        return 1 / (1 + np.exp(np.clip(side[0] - side[1], -700, 700)))

    def accuracies(self) -> list[float]:
        """For each voter: how often it is right when it votes."""
        p = np.exp(np.array(self.logs))
        right = self.prior * p[1, :, 2] + (1 - self.prior) * p[0, :, 0]
        return (right / (right + self.prior * p[1, :, 0] + (1 - self.prior) * p[0, :, 2])).tolist()


def pattern_counts(df: DataFrame, column: str = "votes") -> list[tuple[str, int]]:
    """Counts of the vote strings ('+', '-', '0' a voter); partial sums are taken before the shuffle."""
    return [(r[0], r[1]) for r in df.groupBy(column).agg(F.count("*").alias("n")).collect()]


def parse(patterns: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in p] for p in patterns], int)


#: Chances of the votes -1, 0, 1 at the start, for bad and good rows. A bad row has one kind of fault, so voters on other
#: kinds don't object to it: an objection says much, an approval little.
START = ((0.40, 0.20, 0.40), (0.02, 0.28, 0.70))


def fit(counts: list[tuple[str, int]], voters: int, prior: float = 0.85, strength: float = 0.05, rounds: int = 200) -> VoterModel:
    """Expectation maximisation from START.

    strength: weight of the start, as a share of all rows; it keeps the classes from changing places and rare voters from
    extremes, alike at every size. An empty table gives the start itself.
    """
    if voters > MOST_VOTERS:
        raise ValueError("too many voters")
    start = np.array([[x] * voters for x in START])
    model = VoterModel(prior, tuple(map(tuple, np.log(start))))
    if not counts:
        return model
    votes, n = parse([p for p, _ in counts]), np.array([k for _, k in counts], float)
    strength = strength * n.sum() + 20
    hot = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
    for _ in range(rounds):
        good = model.posterior(votes)
        share = np.stack([n * (1 - good), n * good])
        seen = np.einsum("cp,pvk->cvk", share, hot) + strength * start
        logs = np.log(seen / seen.sum(2, keepdims=True))
        rate = (share[1].sum() + strength * prior) / (n.sum() + strength)
        done = abs(rate - model.prior) < 1e-9
        model = VoterModel(float(np.clip(rate, 1e-4, 1 - 1e-4)), tuple(map(tuple, logs)))
        if done:
            break
    return model


def posteriors(counts: list[tuple[str, int]], model: VoterModel) -> dict[str, float]:
    names = [p for p, _ in counts]
    return dict(zip(names, model.posterior(parse(names)).tolist(), strict=True)) if names else {}
