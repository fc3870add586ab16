"""Problem 2: items above a size limit, cut into overlapping pieces at natural boundaries.

Every place where a piece may end is joined to the farthest legal end of the piece after it (its successor, overlap
included). Squaring the successor table doubles the number of cuts known at once, so that all cuts of a text come out after a
number of rounds that is the logarithm of the number of its pieces.

Defined results: null texts and texts within the limit give no piece; a repeated id is cut once for each of its rows; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import keyed, pieces, values

# Marks at which a text may be cut, besides white space.
SENTENCE_ENDS = ".!?。！？"
CLAUSE_ENDS = ";:,；：，"
WIDE_ENDS = "。！？"

_SPACE, _SENTENCE, _CLAUSE, _WIDE, _LINE = 1, 2, 4, 8, 16
_KINDS = np.zeros(1 << 16, np.uint8)
_KINDS[[c for c in range(1 << 16) if chr(c).isspace()]] = _SPACE
for _marks, _kind in ((SENTENCE_ENDS, _SENTENCE), (CLAUSE_ENDS, _CLAUSE), (WIDE_ENDS, _WIDE), ("\n\r", _LINE)):
    for _mark in _marks:
        _KINDS[ord(_mark)] |= _kind

#: How a piece ends, from the best kind of boundary down.
ENDS = ("end", "paragraph", "sentence", "other", "forced")
SCHEMA = "id long, piece_no int, start int, stop int, ends string, longest_run int, forced int"


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Places after which the text may be cut, the rank of each (1 paragraph, 2 line or sentence, 3 other) and the longest stretch without any."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KINDS[np.minimum(codes, 0xFFFF)]
    kind[codes > 0xFFFE] = 0
    at = np.flatnonzero(kind)
    k = kind[at]
    before = np.where(at > 0, kind[at - 1], 0)
    rank = np.full(len(at), 3, np.int8)
    line = (k & _LINE) > 0
    rank[line | ((k & _WIDE) > 0) | (((k & _SPACE) > 0) & ((before & _SENTENCE) > 0))] = 2
    rank[line & ((before & _LINE) > 0)] = 1
    edges = np.concatenate(([-1], at, [len(codes)]))
    return at + 1, rank, int(np.diff(edges).max() - 1)


def cuts(text: str, capacity: int, overlap: int, fill: float = 0.5) -> tuple[np.ndarray, np.ndarray, int]:
    """Ends of the pieces of a text, the place in ENDS of the kind of each, and the longest stretch without a boundary.

    A piece ends at the farthest boundary of the best rank that fills `fill` of it or more, else at the farthest boundary
    of any kind, else at the limit.
    """
    n, step = len(text), capacity - overlap
    at, rank, run = boundaries(text)
    keep = (at > overlap) & (at < n)
    at, rank = at[keep], rank[keep]
    base = np.concatenate(([overlap], at))
    following = np.append(at, n)
    chain = np.maximum(-(-(following - base) // step) - 1, 0)
    forced = np.repeat(base, chain) + step * (np.arange(chain.sum()) - np.repeat(np.cumsum(chain) - chain, chain) + 1)
    nodes = np.unique(np.concatenate((base, forced, [n])))
    limit = nodes + step
    target, kind = limit.copy(), np.full(len(nodes), 4, np.int8)
    for level, least in ((3, 0), (2, int(step * fill)), (1, int(step * fill))):
        some = at[rank <= level]
        i = np.searchsorted(some, limit, "right") - 1
        if len(some):
            far = np.where(i >= 0, some[i], 0)
            better = far > nodes + least
            target[better], kind[better] = far[better], level
    last = limit >= n
    target[last], kind[last] = n, 0
    successor = np.searchsorted(nodes, target)
    path, table = np.array([np.searchsorted(nodes, overlap)]), successor
    while nodes[path[-1]] < n:
        path = np.concatenate((path, table[path]))
        table = table[table]
    path = path[: np.searchsorted(nodes[path], n) + 1]
    return nodes[path[1:]], kind[path[:-1]], run


def _scan(capacity: int, overlap: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out: list[list] = [[] for _ in range(7)]
            for key, text in zip(values(batch, "id"), values(batch, "text"), strict=True):
                stops, kinds, run = cuts(text, capacity, overlap)
                m = len(stops)
                starts = np.concatenate(([0], stops[:-1] - overlap))
                for column, found in zip(out, ([key] * m, range(m), starts.tolist(), stops.tolist(), [ENDS[k] for k in kinds], [run] * m, [int((kinds == 4).sum())] * m), strict=True):
                    column.extend(found)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            names = ["id", "piece_no", "start", "stop", "ends", "longest_run", "forced"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return scan


def piece_spans(records: DataFrame, capacity: int, overlap: int) -> DataFrame:
    """Spans of the pieces of each text (columns `id`, `text`) of more than `capacity` characters.

    Result: `id`, `piece_no` from 0, `start` and `stop` in characters, how the piece `ends`, the text's `longest_run`
    of characters without a boundary, and how many of its cuts are `forced`. A piece has at most `capacity` characters; the next starts `overlap` before its end.
    """
    if not 0 <= overlap < capacity:
        raise ValueError("overlap must be less than capacity and not negative")
    large = keyed(records).where(F.length("text") > capacity)
    return large.mapInArrow(_scan(capacity, overlap), SCHEMA)


def split_texts(records: DataFrame, capacity: int, overlap: int) -> DataFrame:
    """piece_spans with the `text` of each piece, taken in the same pass."""
    if not 0 <= overlap < capacity:
        raise ValueError("overlap must be less than capacity and not negative")
    spans = _scan(capacity, overlap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            for found in spans(iter([batch])):
                # Pieces come text by text; a new text begins at each piece 0.
                row = np.cumsum(np.array(values(found, "piece_no")) == 0) - 1
                texts = values(batch, "text")
                cut = [texts[i][a:b] for i, a, b in zip(row.tolist(), values(found, "start"), values(found, "stop"), strict=True)]
                yield found.append_column("text", pa.array(cut, pa.string()))

    return keyed(records).where(F.length("text") > capacity).mapInArrow(scan, SCHEMA + ", text string")
