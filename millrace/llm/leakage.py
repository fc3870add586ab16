"""Problem 8: evaluation items, whole, partial or altered, inside long training texts.

The shingles of all items are counted over the whole corpus first; each item's rarest ones are its seeds (and all that few texts have). Where a seed of an item stands in
a text, the words around it are aligned with the item by Smith-Waterman. A pair is a leak if the alignment reaches `aligned` of the
best score that the item can have, which copies with many changed words do too, or if the text has `threshold` of its shingles.

Defined results: null texts and texts or items of fewer words than a shingle never meet; a repeated row counts once;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import pieces, values
from millrace.llm.blocks import BLOCK_CHARS, nothing, over_blocks, usable
from millrace.llm.text import shingle_hashes
from millrace.storage import materialise

SCHEMA = "query_id long, id long, covered int, n_query int, coverage double, alignment int, aligned double, identity double"
HITS = "id long, codes array<int>, places array<int>, words array<int>, cuts array<int>"
#: Words between two shared shingles that still belong to one passage, and words kept on each side of it.
GAP, PAD = 30, 8
#: A shingle found in so many texts, or in a thousandth of those with any hit, is rare: it leads to an alignment by itself.
RARE = 10
#: Alignment scores of a word.
MATCH, MISMATCH, SPACE = 2, -1, 1
#: Cells of an alignment table row, over all pairs, held at once.
CELLS = 2_000_000
_FILTER_BITS = 22


class Items:
    """The shingles and words of a block of items, as sorted hashes whose places serve as codes."""

    def __init__(self, block: list[tuple[int, str]], size: int) -> None:
        hashes, owner, _, word, ends = shingle_hashes([t for _, t in block], size)
        self.ids = np.array([k for k, _ in block], np.int64)
        self.codes = np.unique(hashes)
        self.vocabulary = np.unique(word)
        pairs = np.unique(np.stack([np.searchsorted(self.codes, hashes), owner]), axis=1) if len(hashes) else np.zeros((2, 0), np.int64)
        self.code, self.owner = pairs
        self.counts = np.bincount(self.owner, minlength=len(block))
        words = np.searchsorted(self.vocabulary, word).astype(np.int32) + 1
        self.words = [words[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.codes >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `hashes` of known shingles, and their codes."""
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - _FILTER_BITS)])
        code = np.searchsorted(self.codes, hashes[at])
        code[code == len(self.codes)] = 0
        known = self.codes[code] == hashes[at] if len(self.codes) else np.zeros(len(at), bool)
        return at[known], code[known]

    def word_codes(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of words, 0 for words that no item has."""
        code = np.searchsorted(self.vocabulary, hashes)
        code[code == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[code] == hashes, code + 1, 0).astype(np.int32)

    def seeds(self, frequency: np.ndarray, threshold: float, rare: int) -> tuple[np.ndarray, np.ndarray]:
        """(code, owner) of each item's rarest shingles, as many as no text can lack that covers the item to `threshold`, and of all in up to `rare` texts."""
        order = np.lexsort((self.code, frequency[self.code], self.owner))
        code, owner = self.code[order], self.owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        need = self.counts - np.ceil(self.counts * threshold - 1e-9).astype(np.int64) + 1
        found = frequency[code]
        keep = (found > 0) & ((rank < need[owner]) | (found <= rare))
        return code[keep], owner[keep]


def _lists(owner: np.ndarray, flat: np.ndarray, rows: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), pa.array(flat.astype(np.int32)))


def _hit_scan(shared, size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value, size)
        for batch in pieces(batches, "text"):
            hashes, owner, place, word, ends = shingle_hashes(values(batch, "text"), size)
            at, code = items.find(hashes)
            if not len(at):
                continue
            text, place = owner[at], place[at]
            new = np.ones(len(at), bool)
            new[1:] = (text[1:] != text[:-1]) | (place[1:] - place[:-1] > GAP)
            first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at)) - 1
            begin = np.maximum(place[first] - PAD, 0) + ends[text[first]]
            end = np.minimum(place[last] + size + PAD + ends[text[first]], ends[text[first] + 1])
            length = end - begin
            flat = items.word_codes(word[np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())])
            rows = np.unique(text)
            back = np.searchsorted(rows, text)
            region = back[first]
            # Where a hit stands among the kept words of its text.
            of = np.cumsum(new) - 1
            kept = np.cumsum(length) - length
            places = place + ends[text] - begin[of] + kept[of] - kept[np.searchsorted(region, back)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    _lists(back, code, len(rows)),
                    _lists(back, places, len(rows)),
                    _lists(np.repeat(region, length), flat, len(rows)),
                    _lists(region, length, len(rows)),
                ],
                names=["id", "codes", "places", "words", "cuts"],
            )

    return scan


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair of word code lists, and the number of the item's words with an equal one in the passage.

    All pairs advance together, one word of the item at a time; passages of like length share a table.
    """
    best, same = np.zeros(len(items), np.int32), np.zeros(len(items), np.int32)
    order = np.lexsort(([len(i) for i in items], [len(p) for p in passages]))
    start = 0
    while start < len(order):
        stop, wide = start, 0
        while stop < len(order) and (stop == start or (stop - start + 1) * max(wide, len(passages[order[stop]])) <= CELLS):
            wide = max(wide, len(passages[order[stop]]))
            stop += 1
        part = order[start:stop]
        tall = max(len(items[i]) for i in part)
        a = np.full((len(part), tall), -1, np.int32)
        b = np.zeros((len(part), wide), np.int32)
        for r, i in enumerate(part):
            a[r, : len(items[i])] = items[i]
            b[r, : len(passages[i])] = passages[i]
        slope = np.arange(wide, dtype=np.int32) * SPACE
        above = np.zeros((len(part), wide + 1), np.int32)
        top, common = np.zeros(len(part), np.int32), np.zeros(len(part), np.int32)
        for k in range(tall):
            equal = b == a[:, k : k + 1]
            here = np.maximum(above[:, :-1] + np.where(equal, MATCH, MISMATCH), above[:, 1:] - SPACE)
            np.maximum(here, 0, out=here)
            here = np.maximum.accumulate(here + slope, axis=1) - slope
            above[:, 1:] = here
            np.maximum(top, here.max(axis=1, initial=0), out=top)
            common += equal.any(axis=1)
        best[part], same[part] = top, common
        start = stop
    return best, same


def _windows(item: np.ndarray, place: np.ndarray, length: np.ndarray, cuts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, begin, end) of the stretches of a text's kept words around the seeds of each item, within their passages.

    Seeds of an item that stand no farther apart than the item is long share a stretch; it reaches the item's length beyond them.
    """
    order = np.lexsort((place, item))
    item, place, length = item[order], place[order], length[order]
    bounds = np.concatenate(([0], np.cumsum(cuts)))
    region = np.searchsorted(bounds, place, "right") - 1
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (region[1:] != region[:-1]) | (place[1:] - place[:-1] > length[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item)) - 1
    begin = np.maximum(place[first] - length[first] - PAD, bounds[region[first]])
    end = np.minimum(place[last] + size + length[first] + PAD, bounds[region[first] + 1])
    return item[first], begin, end


def _match_scan(shared, seeds: tuple[np.ndarray, np.ndarray], size: int, threshold: float, aligned: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value, size)
        n = len(items.ids)
        order = np.argsort(seeds[0], kind="stable")
        seed_owner, seed_start = seeds[1][order], np.searchsorted(seeds[0][order], np.arange(len(items.codes) + 1))
        all_start = np.searchsorted(items.code, np.arange(len(items.codes) + 1))
        lengths = np.array([len(w) for w in items.words], np.int64)

        def owners(codes: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(owner, place of its code among the codes)."""
            width = starts[codes + 1] - starts[codes]
            return owner[np.repeat(starts[codes] - np.cumsum(width) + width, width) + np.arange(width.sum())], np.repeat(np.arange(len(codes)), width)

        for batch in pieces(batches, "words", rows=500):
            left, right, keys, found, pair = [], [], [], [], []
            for key, codes, places, flat, cuts in zip(*(values(batch, c) for c in ("id", "codes", "places", "words", "cuts")), strict=True):
                codes, places, flat = np.array(codes, np.int64), np.array(places, np.int64), np.array(flat, np.int32)
                item, of = owners(codes, seed_start, seed_owner)
                if not len(item):
                    continue
                counted = np.bincount(owners(np.unique(codes), all_start, items.owner)[0], minlength=n)
                item, begin, end = _windows(item, places[of], lengths[item], np.array(cuts, np.int64), size)
                here = {}
                for k, x, y in zip(item.tolist(), begin.tolist(), end.tolist(), strict=True):
                    if k not in here:
                        here[k] = len(keys)
                        keys.append((int(items.ids[k]), key, int(counted[k]), int(items.counts[k]), int(lengths[k])))
                    left.append(items.words[k])
                    right.append(flat[x:y])
                    pair.append(here[k])
            if not keys:
                continue
            score, same = align(left, right)
            best, most = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int32)
            np.maximum.at(best, pair, score)
            np.maximum.at(most, pair, same)
            for (query, key, covered, count, length), s, m in zip(keys, best.tolist(), most.tolist(), strict=True):
                share = s / (MATCH * length)
                if share >= aligned or covered >= threshold * count - 1e-9:
                    found.append((query, key, covered, count, covered / count, s, share, m / length))
            if found:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.float64()]
                names = ["query_id", "id", "covered", "n_query", "coverage", "alignment", "aligned", "identity"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return scan


def leaks(queries: DataFrame, texts: DataFrame, *, size: int = 3, threshold: float = 0.5, aligned: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each query item that a text holds: aligned to `aligned` of the best score, or with `threshold` of its shingles.

    Both take columns `id` (long) and `text`. Result: `query_id`, `id`, `covered` shingles of the item's `n_query`, their share
    `coverage`, the best Smith-Waterman `alignment` score of a passage, its share `aligned` of the best possible one, and `identity`, the most
    of the item's words in one passage. Pairs of `coverage` from `threshold` on are all found, as no such text lacks every seed; of the
    others those that share a rare shingle.
    """
    spark = queries.sparkSession

    def run(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)
        hits = materialise(usable(texts).mapInArrow(_hit_scan(shared, size), HITS), "hits")
        counted = hits.select(F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).toArrow()
        items = Items(block, size)
        frequency = np.zeros(len(items.codes) + 1, np.int64)
        frequency[counted.column("code").to_numpy()] = counted.column("n").to_numpy()
        return hits.mapInArrow(_match_scan(shared, items.seeds(frequency, threshold, max(RARE, hits.count() // 1000)), size, threshold, aligned), SCHEMA)

    return over_blocks(usable(queries), run, lambda: nothing(queries, SCHEMA), block_chars).distinct()
