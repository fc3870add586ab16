"""A linear-chain conditional random field over clauses with sets of binary features."""

from __future__ import annotations

import numpy as np


class Chains:
    """Sequences of clauses in arrays: `flat` features, `starts` of the clauses in them, `lengths` and `first` clauses of the sequences."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> None:
        self.flat, self.counts, self.lengths = flat, counts, lengths
        self.n = len(counts)
        self.starts = np.cumsum(counts) - counts
        self.first = np.cumsum(lengths) - lengths
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        self.longest = int(lengths.max(initial=0))
        self.live = np.searchsorted(-ordered, -np.arange(self.longest), "left")

    @classmethod
    def of(cls, sequences: list[list[list[int]]]) -> Chains:
        """From lists of clauses, each with one feature or more."""
        clauses = [c for s in sequences for c in s]
        flat = np.fromiter((f for c in clauses for f in c), np.int64)
        return cls(flat, np.array([len(c) for c in clauses], np.int64), np.array([len(s) for s in sequences], np.int64))

    def at(self, step: int) -> np.ndarray:
        """The clauses of the sequences that have one at this step."""
        return self.first[self.order[: self.live[step]]] + step

    def ends(self) -> np.ndarray:
        """The last clause of each sequence that has any."""
        return (self.first + self.lengths - 1)[self.lengths > 0]


class Field:
    """Weights of features by label and of pairs of neighbouring labels."""

    def __init__(self, features: int, labels: int) -> None:
        self.weights = np.zeros((features, labels))
        self.moves = np.zeros((labels, labels))

    def emissions(self, chains: Chains) -> np.ndarray:
        if not chains.n:
            return np.zeros((0, self.weights.shape[1]))
        return np.add.reduceat(self.weights[chains.flat], chains.starts, axis=0)

    def decode(self, chains: Chains) -> np.ndarray:
        """The best label of each clause (Viterbi, all sequences step by step)."""
        scores = self.emissions(chains)
        back = np.zeros_like(scores, dtype=np.int8)
        for step in range(1, chains.longest):
            here = chains.at(step)
            through = scores[here - 1][:, :, None] + self.moves[None]
            back[here] = through.argmax(axis=1)
            scores[here] += through.max(axis=1)
        labels = np.zeros(chains.n, np.int8)
        labels[chains.ends()] = scores[chains.ends()].argmax(axis=1)
        for step in range(chains.longest - 1, 0, -1):
            here = chains.at(step)
            labels[here - 1] = back[here, labels[here]]
        return labels

    def _sums(self, chains: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(emissions, forward sums, backward sums, total of each clause's sequence), as logarithms."""
        emit = self.emissions(chains)
        forward, backward = emit.copy(), np.zeros_like(emit)
        for step in range(1, chains.longest):
            here = chains.at(step)
            forward[here] += _logsum(forward[here - 1][:, :, None] + self.moves[None])
        for step in range(chains.longest - 1, 0, -1):
            here = chains.at(step)
            backward[here - 1] = _logsum((emit[here] + backward[here])[:, None, :] + self.moves[None], axis=2)
        return emit, forward, backward, np.repeat(_logsum(forward[chains.ends()]), chains.lengths[chains.lengths > 0])

    def chances(self, chains: Chains) -> np.ndarray:
        """The chance of each label of each clause, given its whole sequence."""
        _, forward, backward, total = self._sums(chains)
        return np.exp(forward + backward - total[:, None])

    def gradient(self, chains: Chains, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the weighted mean log-likelihood of the labels, by the forward and backward sums."""
        k = self.weights.shape[1]
        emit, forward, backward, total = self._sums(chains)
        share = np.repeat(weight / weight.sum(), chains.lengths)
        slope = (np.eye(k)[labels] - np.exp(forward + backward - total[:, None])) * share[:, None]
        by_feature = np.repeat(slope, chains.counts, axis=0)
        gain = np.stack([np.bincount(chains.flat, weights=by_feature[:, i], minlength=len(self.weights)) for i in range(k)], axis=1)
        inner = np.ones(chains.n, bool)
        inner[chains.first[chains.lengths > 0]] = False
        here = np.flatnonzero(inner)
        pair = forward[here - 1][:, :, None] + self.moves[None] + (emit[here] + backward[here])[:, None, :] - total[here][:, None, None]
        moves = -(np.exp(pair) * share[here][:, None, None]).sum(axis=0)
        np.add.at(moves, (labels[here - 1], labels[here]), share[here])
        return gain, moves

    def fit(self, chains: Chains, labels: np.ndarray, epochs: int = 20, rate: float = 0.3, ridge: float = 1e-5, batch: int = 512) -> None:
        """Adagrad ascent over batches of sequences in their order, its second half averaged; a sequence weighs the more, the rarer its rarest label is."""
        if not chains.n:
            return
        known, flat = np.unique(chains.flat, return_inverse=True)
        small = Field(len(known), self.weights.shape[1])
        small.weights, small.moves = self.weights[known], self.moves.copy()
        counts = np.bincount(labels, minlength=self.weights.shape[1])
        rare = np.sqrt(counts.max() / np.maximum(counts, 1))
        weight = np.maximum.reduceat(rare[labels], chains.first)
        parts = []
        for begin in range(0, len(chains.lengths), batch):
            lengths = chains.lengths[begin : begin + batch]
            first, n = int(chains.first[begin]), int(lengths.sum())
            counts_of = chains.counts[first : first + n]
            at = int(chains.starts[first])
            parts.append((Chains(flat[at : at + int(counts_of.sum())], counts_of, lengths), labels[first : first + n], weight[begin : begin + batch]))
        held = [np.full_like(small.weights, 1e-8), np.full_like(small.moves, 1e-8)]
        mean = [np.zeros_like(small.weights), np.zeros_like(small.moves)]
        for epoch in range(epochs):
            for part, of, heavy in parts:
                for parameter, gain, square in zip((small.weights, small.moves), small.gradient(part, of, heavy), held, strict=True):
                    gain = gain - ridge * parameter
                    square += gain**2
                    parameter += rate * gain / np.sqrt(square)
            if epoch >= epochs // 2:
                for total, parameter in zip(mean, (small.weights, small.moves), strict=True):
                    total += parameter / (epochs - epochs // 2)
        self.weights[known], self.moves = mean


def _logsum(x: np.ndarray, axis: int = 1) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)
