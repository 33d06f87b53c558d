"""A label model for noisy labelling functions, fitted by expectation maximisation.

For one defect each labelling function votes 1 or 0 or abstains. Votes are taken as independent given the
hidden label; class balance and each function's two rates are estimated by EM from the counts of vote
patterns alone, of which there are at most 3**k whatever the number of rows. All functions start alike;
an abstention says nothing about the label.

The cutoff is validated on rows held out from fitting: planted defects, whose label is known, and the rows as they are,
whose labels aren't. ``recall ** 2 / share taken`` needs only these two and grows with F1.
"""

from __future__ import annotations

import numpy as np

NO, YES, ABSTAIN = 0, 1, 2
#: What is assumed of every function and of the defect before the data are seen, and how many rows that is worth.
HIT, FALSE, PRIOR, STRENGTH = 0.8, 0.05, 0.03, 4.0
#: How far the cutoff's worth may be from the best: what is planted isn't mixed quite like what is found.
TOLERANCE = 0.005


class LabelModel:
    """Naive Bayes with a hidden class over ``functions`` votes, the same start for each."""

    def __init__(self, functions: int):
        self.hit, self.false, self.prior = np.full(functions, HIT), np.full(functions, FALSE), PRIOR
        self.cutoff, self.recall, self.taken = 0.5, float("nan"), float("nan")

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(defect | votes) of each row of ``votes`` (patterns x functions); where all abstain it is 0."""
        v, heard = (votes == YES).astype(float), (votes != ABSTAIN).astype(float)
        pos = np.log(self.prior) + v @ np.log(self.hit) + (heard - v) @ np.log1p(-self.hit)
        neg = np.log1p(-self.prior) + v @ np.log(self.false) + (heard - v) @ np.log1p(-self.false)
        return np.where(heard.any(1), 1 / (1 + np.exp(np.clip(neg - pos, -500, 500))), 0.0)

    def fit(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
        heard = (votes != ABSTAIN).astype(float)
        counts = counts.astype(float) * heard.any(1)
        if not counts.sum():
            return self
        yes = (votes == YES).astype(float)
        for _ in range(rounds):
            p = self.posterior(votes) * counts
            q = counts - p
            self.prior = float(np.clip((p.sum() + STRENGTH * PRIOR) / (counts.sum() + STRENGTH), 1e-6, 0.5))
            self.hit = np.clip((p @ yes + STRENGTH * HIT) / (p @ heard + STRENGTH), 1e-4, 1 - 1e-4)
            self.false = np.clip((q @ yes + STRENGTH * FALSE) / (q @ heard + STRENGTH), 1e-6, 1 - 1e-4)
        return self

    def validate(self, planted: np.ndarray, planted_counts: np.ndarray, votes: np.ndarray, counts: np.ndarray) -> LabelModel:
        """The lowest cutoff at which ``recall ** 2 / share taken`` is next to its greatest.

        planted: votes on pairs that were made defective; votes: on held-out pairs as they are. With nothing planted it stays 0.5.
        """
        p, q = self.posterior(planted), self.posterior(votes)
        made, rows = planted_counts.sum(), counts.sum()
        if not made or not rows:
            return self
        tried = []
        for cut in sorted({0.5, *(round(float(x), 6) for x in (*p, *q) if x >= 0.01)}):
            recall, taken = planted_counts[p >= cut - 1e-6].sum() / made, (counts[q >= cut - 1e-6].sum() + 1) / (rows + 1)
            tried.append((round(recall**2 / taken, 6), cut - 1e-6, float(recall), float(taken)))
        good = max(tried)[0] * (1 - TOLERANCE)
        _, self.cutoff, self.recall, self.taken = min((x for x in tried if x[0] >= good), key=lambda x: x[1])
        return self
