import numpy as np
import pytest

from logweave.llm import weak_labels

#: Chance that a voter speaks, and that it is right on good and on bad rows when it does.
PLANTED = [(0.9, 0.95, 0.90), (0.8, 0.90, 0.85), (0.9, 0.85, 0.80), (0.6, 0.90, 0.90), (0.7, 0.80, 0.75), (0.9, 0.75, 0.70), (0.5, 0.95, 0.80), (0.8, 0.70, 0.70), (0.4, 0.85, 0.85)]


def drawn(n: int, good_share: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Independent votes (-1, 0, 1) of PLANTED voters, and the truth."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < good_share
    votes = []
    for speaks, on_good, on_bad in PLANTED:
        right = rng.random(n) < np.where(good, on_good, on_bad)
        votes.append(np.where(rng.random(n) < speaks, np.where(right == good, 1, -1), 0))
    return np.stack(votes, 1), good


def counted(votes: np.ndarray) -> list[tuple[str, int]]:
    names = ["".join("-0+"[v + 1] for v in row) for row in votes.tolist()]
    found, n = np.unique(names, return_counts=True)
    return list(zip(found.tolist(), n.tolist(), strict=True))


@pytest.mark.parametrize("good_share", [0.5, 0.8, 0.9])
@pytest.mark.parametrize("n", [3000, 30000])
def test_planted_accuracies(n, good_share):
    votes, good = drawn(n, good_share, 3)
    model = weak_labels.fit(counted(votes), len(PLANTED))
    said = (votes != 0).sum(0)
    true = [(votes[:, v] == np.where(good, 1, -1)).sum() / said[v] for v in range(len(PLANTED))]
    assert model.accuracies() == pytest.approx(true, abs=0.05)
    assert model.prior == pytest.approx(good.mean(), abs=0.05)
    judged = model.posterior(votes) >= 0.5
    majority = votes.sum(1) > 0
    assert (judged == good).mean() >= (majority == good).mean()
    assert (judged == good).mean() > 0.95


def test_counts_scale_the_same():
    """Ten times each pattern gives the same model but for the constant part of the start's weight."""
    votes, _ = drawn(5000, 0.8, 4)
    one = weak_labels.fit(counted(votes), len(PLANTED))
    ten = weak_labels.fit([(p, 10 * k) for p, k in counted(votes)], len(PLANTED))
    assert one.accuracies() == pytest.approx(ten.accuracies(), abs=0.02)


def test_no_rows_and_one_pattern():
    empty = weak_labels.fit([], 3)
    assert empty.posterior(np.array([[1, 1, 1]]))[0] > 0.5 > empty.posterior(np.array([[-1, -1, -1]]))[0]
    assert weak_labels.posteriors([], empty) == {}
    silent = weak_labels.fit([("000", 7)], 3)
    assert 0 < weak_labels.posteriors([("000", 7)], silent)["000"] < 1
    with pytest.raises(ValueError, match="too many voters"):
        weak_labels.fit([], weak_labels.MOST_VOTERS + 1)


def test_pattern_counts_cover_all_rows(spark):
    votes, _ = drawn(2000, 0.7, 5)
    want = dict(counted(votes))
    rows = [(p,) for p, n in want.items() for _ in range(n)]
    assert dict(weak_labels.pattern_counts(spark.createDataFrame(rows, "votes string"))) == want
