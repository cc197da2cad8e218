"""A linear-chain conditional random field in numpy.

The score of a tag sequence is the sum, over its tokens, of the weights of the token's
features for its tag, and of the transition weights between neighbouring tags. Weights
maximise the likelihood of labelled sequences with an L2 penalty; the best sequence is
found by Viterbi's recursion.
"""

from __future__ import annotations

import numpy as np


class Model:
    """weights: (features, tags); moves: (tags, tags), from the row's tag to the column's; first: (tags,)."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, moves: np.ndarray, first: np.ndarray) -> None:
        self.features, self.weights, self.moves, self.first = features, weights, moves, first

    def emission(self, names: list[str]) -> np.ndarray:
        """Sum of the weights of the features that training has seen."""
        known = [self.features[n] for n in names if n in self.features]
        return self.weights[known].sum(axis=0) if known else np.zeros(self.weights.shape[1])

    def decode(self, emissions: np.ndarray, before: int | None = None, after: int | None = None) -> list[int]:
        """The best tags of a sequence, given the tags on either side of it where they are known."""
        score = emissions[0] + (self.first if before is None else self.moves[before])
        back = np.empty(emissions.shape, np.int64)
        for t in range(1, len(emissions)):
            step = score[:, None] + self.moves
            back[t] = step.argmax(axis=0)
            score = step.max(axis=0) + emissions[t]
        if after is not None:
            score = score + self.moves[:, after]
        tags = [int(score.argmax())]
        for t in range(len(emissions) - 1, 0, -1):
            tags.append(int(back[t, tags[-1]]))
        return tags[::-1]

    def swing(self) -> float:
        """How much the transitions around one token can differ between two tags of it."""
        every = np.vstack((self.moves, self.first))
        return float((every.max() - every.min()) + (self.moves.max() - self.moves.min()))


def train(sequences: list[list[tuple[list[str], int]]], tags: int, penalty: float = 0.02, steps: int = 150, rate: float = 0.5) -> Model:
    """Fits a model to sequences of (feature names, tag) by gradient ascent with per-weight step sizes."""
    features = {n: i for i, n in enumerate(sorted({n for s in sequences for names, _ in s for n in names}))}
    longest = max(map(len, sequences))
    count = len(sequences)
    # token features as flat (cell, feature) pairs; a cell is a place in the padded grid
    pairs = np.array([(s * longest + t, features[n]) for s, seq in enumerate(sequences) for t, (names, _) in enumerate(seq) for n in names])
    cells, columns = pairs[:, 0], pairs[:, 1]
    alive = np.zeros((count, longest), bool)
    gold = np.zeros((count, longest), np.int64)
    for s, seq in enumerate(sequences):
        alive[s, : len(seq)] = True
        gold[s, : len(seq)] = [tag for _, tag in seq]
    onehot = np.eye(tags)[gold] * alive[..., None]
    both = alive[:, 1:]
    gold_moves = np.einsum("sti,stj->ij", onehot[:, :-1] * both[..., None], onehot[:, 1:])
    parts = [np.zeros((len(features), tags)), np.zeros((tags, tags)), np.zeros(tags)]
    squares = [np.full(p.shape, 1e-8) for p in parts]

    def gathered(values: np.ndarray) -> np.ndarray:
        """Sums of per-cell values by feature."""
        flat = values.reshape(-1, tags)
        return np.stack([np.bincount(columns, flat[cells, k], len(features)) for k in range(tags)], axis=1)

    gold_features = gathered(onehot)
    for _ in range(steps):
        weights, moves, first = parts
        emission = np.stack([np.bincount(cells, weights[columns, k], count * longest) for k in range(tags)], axis=1).reshape(count, longest, tags)
        forward = np.empty((count, longest, tags))
        forward[:, 0] = emission[:, 0] + first
        for t in range(1, longest):
            step = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + emission[:, t]
            forward[:, t] = np.where(alive[:, t, None], step, forward[:, t - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        backward = np.zeros((count, longest, tags))
        expected_moves = np.zeros((tags, tags))
        for t in range(longest - 2, -1, -1):
            following = emission[:, t + 1] + backward[:, t + 1]
            step = np.logaddexp.reduce(moves + following[:, None, :], axis=2)
            backward[:, t] = np.where(alive[:, t + 1, None], step, 0.0)
            joint = np.exp(forward[:, t, :, None] + moves + following[:, None, :] - total[:, None, None])
            expected_moves += (joint * alive[:, t + 1, None, None]).sum(axis=0)
        expected = np.exp(forward + backward - total[:, None, None]) * alive[..., None]
        gradients = [gold_features - gathered(expected), gold_moves - expected_moves, onehot[:, 0].sum(axis=0) - expected[:, 0].sum(axis=0)]
        for p, s, g in zip(parts, squares, gradients, strict=True):
            g -= penalty * p
            s += g * g
            p += rate * g / np.sqrt(s)
    return Model(features, *parts)
