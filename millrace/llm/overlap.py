"""Problem 1: the same or almost the same record in an evaluation split and in the training split.

The rarest shingles of the evaluation passages of a block form one Aho-Corasick automaton, which scans every training text. Where it
hits, the shingles that both share are counted; the word intervals that they take in the evaluation passage are merged into its coverage.

Defined results: null texts and texts of fewer words than a shingle overlap with nothing; a repeated row counts once;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.arrow import pieces, values
from millrace.llm.blocks import BLOCK_CHARS, nothing, over_blocks, usable
from millrace.llm.text import words

SCHEMA = "query_id long, id long, shared int, n_query int, n_text int, overlap double, coverage double"


class Automaton:
    """The shingles of a block of evaluation passages, with the records that each stands for.

    A record's seeds are its shingles that the fewest records of the block have, as many as no text can lack that overlaps it by the
    threshold. Only seeds lead from a text to records, so that a shingle that all records have leads to none.
    """

    def __init__(self, block: list[tuple[int, str]], size: int, threshold: float) -> None:
        self.size, self.tree = size, ahocorasick.Automaton()
        codes: dict[str, int] = {}
        kept, self.texts, flat, counts = [], [], [], []
        for key, text in block:
            mine = {codes.setdefault(p, len(codes)) for p in self.passages(words(text))}
            if mine:
                kept.append(key)
                self.texts.append(text)
                flat += sorted(mine)
                counts.append(len(mine))
        self.codes, self.ids, self.counts = codes, np.array(kept, np.int64), np.array(counts, np.int64)
        self.flat, self.starts = np.array(flat, np.int64), np.concatenate(([0], np.cumsum(self.counts)))
        owner = np.repeat(np.arange(len(kept)), self.counts)
        order = np.lexsort((self.flat, np.bincount(self.flat, minlength=len(codes))[self.flat], owner))
        rank = np.arange(len(owner)) - self.starts[owner]
        need = self.counts - np.ceil(self.counts * threshold - 1e-9).astype(np.int64) + 1
        seeds = order[rank < need[owner]]
        seeds = seeds[np.argsort(self.flat[seeds], kind="stable")]
        self.owners, self.seed_starts = owner[seeds], np.searchsorted(self.flat[seeds], np.arange(len(codes) + 1))
        # Seeds alone are scanned for; what else a text shares is looked up where they lead to a record.
        wanted = np.diff(self.seed_starts) > 0
        for passage, code in codes.items():
            if wanted[code]:
                self.tree.add_word(passage, code)
        if wanted.any():
            self.tree.make_automaton()

    def passages(self, w: list[str]) -> list[str]:
        return [f" {' '.join(w[i : i + self.size])} " for i in range(len(w) - self.size + 1)]

    def hits(self, w: list[str]) -> set[int]:
        """The known shingles of a text's words, none if it has no seed."""
        if len(w) < self.size or next(self.tree.iter(f" {' '.join(w)} "), None) is None:
            return set()
        return {self.codes[p] for p in self.passages(w) if p in self.codes}

    def candidates(self, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, record) pairs of which the text has a seed of the record, each once."""
        width = self.seed_starts[code + 1] - self.seed_starts[code]
        at = np.repeat(self.seed_starts[code] - np.cumsum(width) + width, width) + np.arange(width.sum())
        pairs = np.unique(np.repeat(row, width) * len(self.ids) + self.owners[at])
        return pairs // len(self.ids), pairs % len(self.ids)

    def shared(self, row: np.ndarray, code: np.ndarray, text: np.ndarray, record: np.ndarray) -> np.ndarray:
        """How many of each record's shingles its text has; (row, code) are the hits of all texts."""
        n = len(self.codes)
        known = np.sort(row * n + code)
        width = self.counts[record]
        begin = np.cumsum(width) - width
        wanted = self.flat[np.repeat(self.starts[record] - begin, width) + np.arange(width.sum())] + np.repeat(text, width) * n
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return np.add.reduceat((known[at] == wanted).astype(np.int64), begin) if len(record) else np.zeros(0, np.int64)

    def coverage(self, k: int, hits: set[int]) -> float:
        """Share of the words of passage k inside the merged intervals of its shingles among the hits."""
        w = words(self.texts[k])
        covered = reach = 0
        for at, passage in enumerate(self.passages(w)):
            if self.codes[passage] in hits:
                covered += at + self.size - max(at, reach)
                reach = at + self.size
        return covered / len(w)


_HELD: dict[str, Automaton] = {}


def _held(key: str, make: Callable[[], Automaton]) -> Automaton:
    """The automaton of a block, built once in each worker process; the one before it is let go."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def _scan(shared, key: str, size: int, threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _held(key, lambda: Automaton(shared.value, size, threshold))
        if not len(auto.ids):
            return
        for batch in pieces(batches, "text"):
            ids, split = values(batch, "id"), [words(t) for t in values(batch, "text")]
            hits = list(map(auto.hits, split))
            row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
            code = np.fromiter((c for h in hits for c in h), np.int64, len(row))
            text, record = auto.candidates(row, code)
            if not len(text):
                continue
            both = auto.shared(row, code, text, record)
            likely = both >= auto.counts[record] * threshold - 1e-9
            out = []
            for r, k, n in zip(text[likely].tolist(), record[likely].tolist(), both[likely].tolist(), strict=True):
                w, mine = split[r], int(auto.counts[k])
                theirs = len(set(zip(*(w[i:] for i in range(size)), strict=False)))
                if (score := n / (mine + theirs - n)) >= threshold:
                    out.append((int(auto.ids[k]), ids[r], n, mine, theirs, score, auto.coverage(k, hits[r])))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
                names = ["query_id", "id", "shared", "n_query", "n_text", "overlap", "coverage"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return scan


def overlaps(queries: DataFrame, texts: DataFrame, *, size: int = 3, threshold: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each pair of a query and a text whose shingle sets overlap by `threshold` or more.

    Both take columns `id` (long) and `text`. Result: `query_id`, `id`, `shared` shingles, `n_query`, `n_text`, `overlap`
    (shared shingles over shingles in either) and `coverage` (share of the query's words inside shared shingles).
    """

    def run(block: list[tuple[int, str]]) -> DataFrame:
        shared = queries.sparkSession.sparkContext.broadcast(block)
        return usable(texts).mapInArrow(_scan(shared, uuid.uuid4().hex, size, threshold), SCHEMA)

    return over_blocks(usable(queries), run, lambda: nothing(queries, SCHEMA), block_chars).distinct()
