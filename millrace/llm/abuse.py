"""Problem 9: abusive, hateful or sexual passages.

A linear classifier of character n-grams, each scaled by its naive Bayes log-count ratio, scores every passage (sentence or
line) of a text; a text's score is that of its worst passage. Ratings are of whole texts: which passages of a text that was
rated as abusive bear that out is found in rounds, by the classifier so far.

Defined results: a null or empty text scores 0; ratings that are null, unknown or disagree are not learned from; without both
kinds of ratings every text scores 0; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import keyed, pieces, values
from millrace.llm.text import folded
from millrace.storage import materialise

# Cyrillic and Greek letters that look like Latin ones, and digits and marks that stand for letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁһқтнмквοαυ", "aeopcyxijsdhqthmkboau", strict=True))
LEET = dict(zip("0134578@$!", "oieastbasi", strict=True))
SENTENCE_ENDS = ".!?。！？…;"

ORDERS = (3, 4, 5)
BITS = 18
#: Longest passage; a longer one is cut.
PASSAGE = 400
#: Least log-odds from which a text counts as bad.
LEAST_MARGIN = 0.0
#: Characters that are scored at once.
SLICE = 1_500_000
#: Texts rated as bad, other rated texts and characters that the classifier is fitted on at the most.
MOST_BAD, MOST_OTHER, MOST_CHARS = 1000, 2500, 10_000_000
_LOW = 0x530

_LETTER = np.array([chr(c).isalpha() for c in range(_LOW)])
_DIGIT = np.array([chr(c).isdigit() for c in range(_LOW)])
_ALIKE = np.arange(_LOW, dtype=np.uint32)
for _a, _b in LOOKALIKES.items():
    _ALIKE[ord(_a)] = ord(_b)
_LEET = np.arange(_LOW, dtype=np.uint32)
for _a, _b in LEET.items():
    _LEET[ord(_a)] = ord(_b)
_FOREIGN = (_ALIKE != np.arange(_LOW))
_BREAK = np.zeros(_LOW, bool)
_BREAK[[ord(c) for c in SENTENCE_ENDS if ord(c) < _LOW]] = True


def _plain(codes: np.ndarray) -> np.ndarray:
    """Codes with look-alikes and digits in words turned into the Latin letters that they stand for, other digits into 0."""
    low = np.minimum(codes, _LOW - 1)
    letter, digit = _LETTER[low], _DIGIT[low]
    inside = letter | digit | (codes == 64) | (codes == 36)
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    if len(begin):
        total = np.concatenate(([0], np.cumsum((letter & (codes < 128)).astype(np.int32) + ((letter & _FOREIGN[low]).astype(np.int64) << 32))))
        found = total[end] - total[begin]
        latin, foreign = found & 0xFFFFFFFF, found >> 32
        size = end - begin
        mixed = (latin > 0) & (foreign > 0)
        leet = (latin >= 2) & (size >= 4) & (latin + foreign < size)
        out = codes.copy()
        for chosen, table in ((mixed, _ALIKE), (leet, _LEET)):
            if chosen.any():
                at = np.repeat(begin[chosen] - np.concatenate(([0], np.cumsum(size[chosen])[:-1])), size[chosen]) + np.arange(size[chosen].sum())
                out[at] = np.where(out[at] < _LOW, table[np.minimum(out[at], _LOW - 1)], out[at])
                digit[at] = False
        out[digit] = 48
        return out
    return codes


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all texts, starts of the passages in them, text of each passage)."""
    joined = [folded(t) if t else "" for t in texts]
    lengths = np.array([len(t) + 1 for t in joined])
    codes = np.frombuffer(("\n".join(joined) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = codes == 10
    low = np.minimum(codes, _LOW - 1)
    ends = _BREAK[low] | ((codes >= 0x2026) & np.isin(codes, [ord(c) for c in SENTENCE_ENDS if ord(c) >= _LOW]))
    space = np.append((codes[1:] == 32) | (codes[1:] >= 0x3000), True)
    stop = stop | (ends & (space | (codes > _LOW)))
    edges = np.concatenate(([0], np.flatnonzero(stop) + 1))
    starts, sizes = edges[:-1], np.diff(edges)
    parts = -(-sizes // PASSAGE)
    if (parts > 1).any():
        offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + PASSAGE * offset
    owner = np.searchsorted(np.cumsum(lengths), starts, "right")
    return _plain(codes), starts, owner


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """For each order, the hashed n-gram that begins at each character."""
    found, h = [], codes.astype(np.uint32)
    base = h.copy()
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + base[n - 1 :]
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)
            found.append((mixed >> np.uint32(32 - BITS)).astype(np.int32))
    return found


#: A classifier that finds nothing bad.
NOTHING = (np.zeros((len(ORDERS), 1 << BITS), np.float32), -20.0)


def passage_scores(codes: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each passage's n-grams, over the root of its length."""
    total = np.zeros(len(codes), np.float32)
    for g, w in zip(grams(codes), weights, strict=True):
        total[: len(g)] += w[g]
    size = np.diff(np.append(starts, len(codes)))
    return np.add.reduceat(total, starts) / np.sqrt(np.maximum(size, 16)) if len(starts) else np.zeros(0, np.float32)


def _log_ratio(one: np.ndarray, zero: np.ndarray, n_one: int, n_zero: int, smooth: float, errors: float) -> np.ndarray:
    """Naive Bayes log-count ratios, drawn towards 0 by `errors` standard errors."""
    p, q = one + smooth, zero + smooth
    ratio = np.log(p / (n_one + 2 * smooth)) - np.log(q / (n_zero + 2 * smooth))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - errors * np.sqrt(1 / p + 1 / q), 0)


def _logistic(flat: np.ndarray, row: np.ndarray, scale: np.ndarray, label: np.ndarray, weight: np.ndarray, ratio: np.ndarray, steps: int, ridge: float) -> tuple[np.ndarray, float]:
    """Logistic regression on n-gram counts scaled by `ratio`, by Adam over the whole sample."""
    beta, bias = np.ones(len(ratio)), -2.0
    m = v = np.zeros(len(ratio) + 1)
    total = weight.sum()
    for t in range(1, steps + 1):
        score = np.bincount(row, weights=(beta * ratio)[flat], minlength=len(label)) * scale + bias
        error = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - label) / total
        slope = np.append(np.bincount(flat, weights=(error * scale)[row], minlength=len(ratio)) * ratio + ridge * (beta - 1), error.sum())
        m = 0.8 * m + 0.2 * slope
        v = 0.95 * v + 0.05 * slope**2
        step = 0.05 * (m / (1 - 0.8**t)) / (np.sqrt(v / (1 - 0.95**t)) + 1e-9)
        beta = beta - step[:-1]
        bias -= 2 * float(step[-1])
    return beta * ratio, bias


def cut(best: np.ndarray, bad: np.ndarray) -> float:
    """Log-odds between the two groups: halfway from what 98 % of the other texts stay under to what 95 % of the bad ones pass.

    The scores are those of each text's worst passage by a classifier that was fitted on other texts. Texts rated as bad whose worst passage is like those of others are wrong ratings and don't count.
    """
    if bad.all() or not bad.any():
        return LEAST_MARGIN
    others = max(0.0, float(np.quantile(best[~bad], 0.98)))
    clear = best[bad & (best > max(others, LEAST_MARGIN))]
    return max(LEAST_MARGIN, others + 0.5 * (float(np.quantile(clear, 0.05)) - others)) if len(clear) else LEAST_MARGIN


def fit(texts: list[str], bad: np.ndarray, rounds: int = 3, steps: int = 30, ridge: float = 1e-5, smooth: float = 0.3, errors: float = 1.5) -> tuple[np.ndarray, float]:
    """(weights by order, bias) of passages, from texts and whether each was rated as bad as a whole.

    The first log-count ratios compare texts; each round then takes the passages of bad texts that score above what hardly
    any other text reaches as bad, compares passages, and fits the weights. Bad texts without such a passage are taken for wrong
    ratings and left out.
    """
    size = 1 << BITS
    width = size * len(ORDERS)
    if not bad.any() or bad.all():
        return NOTHING
    step = 200

    def read(begin: int) -> tuple[np.ndarray, ...]:
        codes, starts, owner = passages(texts[begin : begin + step])
        sizes = np.diff(np.append(starts, len(codes)))
        row = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
        return owner, sizes, row, grams(codes)

    counts = np.zeros((2, width), np.int32)
    for begin in range(0, len(texts), step):
        owner, _, row, found = read(begin)
        for i, g in enumerate(found):
            held = np.unique((owner[row[: len(g)]] << BITS) | g)
            of = bad[begin + (held >> BITS)]
            for k in (0, 1):
                counts[k, i * size : (i + 1) * size] += np.bincount(held[of == k] & (size - 1), minlength=size)
    first = _log_ratio(counts[1], counts[0], int(bad.sum()), int((~bad).sum()), smooth, errors)
    seen = np.flatnonzero((counts[1] >= 2) & (first != 0))  # what fewer bad texts have, or others as often, says nothing
    place = np.full(width, -1, np.int32)
    place[seen] = np.arange(len(seen))
    owners, lengths, flats, rows, at = [], [], [], [], 0
    for begin in range(0, len(texts), step):
        owner, sizes, row, found = read(begin)
        for i, g in enumerate(found):
            known = place[g + np.int32(i * size)]
            keep = known >= 0
            flats.append(known[keep])
            rows.append(row[: len(g)][keep] + np.int32(at))
        owners.append(owner + begin)
        lengths.append(sizes)
        at += len(sizes)
    owner, sizes = np.concatenate(owners), np.concatenate(lengths)
    scale = 1 / np.sqrt(np.maximum(sizes, 16))
    flat, row = np.concatenate(flats), np.concatenate(rows)
    ratio, bias = first[seen], 0.0
    weights = ratio
    bad_passage = bad[owner]
    score = np.bincount(row, weights=np.maximum(ratio, 0)[flat], minlength=len(owner)) * scale
    for _ in range(rounds):
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, score)
        line = np.quantile(best[~bad], 0.98)
        one, zero = bad_passage & (score > line), ~bad_passage
        if not one.any() or not zero.any():
            break
        use = one | zero
        inside = use[row]
        held = np.unique(row[inside].astype(np.int64) * len(seen) + flat[inside])
        label_of = one[held // len(seen)]
        pair = [np.bincount((held % len(seen))[label_of == k], minlength=len(seen)) for k in (0, 1)]
        ratio = _log_ratio(pair[1], pair[0], int(one.sum()), int(zero.sum()), smooth, errors)
        number = np.cumsum(use) - 1
        label = one[use].astype(np.float64)
        weight = np.where(label > 0, 1.0, 4 * label.sum() / (len(label) - label.sum()))
        weights, bias = _logistic(flat[inside], number[row[inside]], scale[use], label, weight, ratio, steps, ridge)
        score = np.bincount(row, weights=weights[flat], minlength=len(owner)) * scale + bias
    out = np.zeros(width, np.float32)
    out[seen] = weights
    return out.reshape(len(ORDERS), size), float(bias)


def worst(texts: list[str], weights: np.ndarray, bias: float, step: int = 200) -> np.ndarray:
    """The log-odds of the worst passage of each text."""
    best = np.full(len(texts), -30.0)
    for begin in range(0, len(texts), step):
        codes, starts, owner = passages(texts[begin : begin + step])
        np.maximum.at(best, begin + owner, passage_scores(codes, starts, weights) + bias)
    return best


def sliced(text: str | None) -> list[str]:
    """A text in parts of at most SLICE characters, cut at line breaks or spaces where there are any."""
    text, out, at = text or "", [], 0
    while len(text) - at > SLICE:
        cut = max(text.rfind("\n", at, at + SLICE), text.rfind(" ", at + SLICE // 2, at + SLICE)) + 1
        cut = cut if cut > at + SLICE // 2 else at + SLICE
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def ratings(labels: DataFrame) -> DataFrame:
    """`id`, `bad` of the texts whose usable ratings agree on whether they are bad."""
    category = F.lower(F.trim("category"))
    rated = labels.where(F.col("id").isNotNull() & category.isin("none", "abusive", "hateful", "sexual")).groupBy("id")
    rated = rated.agg(F.min(category != "none").alias("low"), F.max(category != "none").alias("bad"))
    return rated.where(F.col("low") == F.col("bad")).select("id", "bad")


def train(records: DataFrame, labels: DataFrame, most_bad: int = MOST_BAD, most_other: int = MOST_OTHER, most_chars: int = MOST_CHARS) -> tuple[np.ndarray, float]:
    """The classifier, fitted in one task on a seeded sample of the rated texts, bounded by the three numbers.

    Beside it two more tasks fit on one half of the sample each and score the other: these scores set the line between bad and other texts.
    """
    order = F.xxhash64(F.lit(3), "id")
    rated = ratings(labels)
    some = [rated.where(F.col("bad") == b).orderBy(order, "id").limit(n) for b, n in ((True, most_bad), (False, most_other))]
    chosen = F.broadcast(some[0].unionByName(some[1]))
    known = keyed(records).where(F.col("id").isNotNull() & (F.length("text") > 0)).join(chosen, "id").dropDuplicates(["id"])
    sample = materialise(known.withColumn("half", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(2)).cast("int")), "rated")

    def fitting(held: int | None):
        """Fits on the texts outside a half, and scores those of it; without one, fits on all."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts, bad, half, chars = [], [], [], 0
            for batch in batches:
                for text, b, h in zip(*(values(batch, c) for c in ("text", "bad", "half")), strict=True):
                    if chars + len(text) <= most_chars:
                        texts.append(text)
                        bad.append(b)
                        half.append(h)
                        chars += len(text)
            inside = [h != held for h in half]
            weights, bias = fit([t for t, i in zip(texts, inside, strict=True) if i], np.array(bad, bool)[np.array(inside, bool)]) if any(inside) else NOTHING
            others = [t for t, i in zip(texts, inside, strict=True) if not i]
            best = worst(others, weights, bias)
            of = [b for b, i in zip(bad, inside, strict=True) if not i]
            columns = [pa.array([weights.tobytes() if held is None else b""], pa.binary()), pa.array([bias]), pa.array([best.tolist()], pa.list_(pa.float64())), pa.array([of], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, names=["weights", "bias", "best", "bad"])

        return run

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(5), "id"), "id")
    with ThreadPoolExecutor(3) as pool:
        whole, *halves = pool.map(lambda held: ordered.mapInArrow(fitting(held), "weights binary, bias double, best array<double>, bad array<boolean>").first(), (None, 0, 1))
    if whole is None:
        return NOTHING
    rows = [r for r in halves if r is not None]
    best, bad = (np.array([x for r in rows for x in r[c]], kind) for c, kind in (("best", float), ("bad", bool)))
    return np.frombuffer(whole.weights, np.float32).reshape(len(ORDERS), -1), whole.bias - cut(best, bad)


def score(records: DataFrame, model: tuple[np.ndarray, float], others: list[str] = ()) -> DataFrame:
    """`id`, the columns named in `others`, and the `score` (0 to 1, bad from 0.5 on) of each text's worst passage."""
    shared = records.sparkSession.sparkContext.broadcast(model)
    kept = ["id", *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in pieces(batches, "text", most=SLICE):
            slices = [(i, part) for i, t in enumerate(values(batch, "text")) for part in sliced(t)]
            worst = np.full(batch.num_rows, -30.0)
            for _, some in groupby(enumerate(slices), lambda x: x[0] if len(x[1][1]) > SLICE // 2 else -1):
                rows, parts = zip(*[x for _, x in some], strict=True)
                codes, starts, owner = passages(list(parts))
                np.maximum.at(worst, np.array(rows)[owner], passage_scores(codes, starts, weights) + bias)
            chance = 1 / (1 + np.exp(-np.clip(worst, -30, 30)))
            empty = np.array([not t for t in values(batch, "text")])
            chance[empty] = 0
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(chance)], names=[*kept, "score"])

    source = keyed(records, *others)
    return source.mapInArrow(run, source.drop("text").schema.add("score", "double"))
