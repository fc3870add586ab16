"""Problem 4: answers that fail their question.

A response is cut into clauses. A conditional random field tags each as answer, refusal, echo (of the question), foreign (in
another language than the question) or unfinished (work that breaks off before a result). Its features are what a clause
shares with the question, its characters' language against the question's, its shape, its place and its words. The words that each
tag is expected to cover, as shares of the response, then decide on the defect by a softmax regression. Nothing is looked up in word lists.

No ratings of responses exist. Field and regression are fitted on examples made from a bounded sample of the pairs at hand
(`defect_examples`): sound responses as they are, cut off, in other languages or behind the question, copies of questions, and refusals.

Defined results: a null, blank or placeholder response, or no response, is `empty`; a null question has no language and nothing to
echo; a repeated id gives a row for each defect of its rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import languages as L
from millrace.llm.arrow import pieces, values
from millrace.llm.crf import Chains, Field
from millrace.llm.text import INVISIBLE, WORD, folded, words

ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Defects that the covered shares decide on; None is a sound pair. `empty` responses have no clause.
DEFECTS = (None, "refusal", "copy", "language", "truncated")
#: Rounds of fitting the field over its examples.
EPOCHS = 25
#: Pairs that the field is fitted on at the most, and characters of the longest text among them: bounds of the training sample only.
MOST_ROWS, MOST_CHARS = 4000, 20_000

# Placeholders that carry no content, beside responses without a letter or digit.
PLACEHOLDERS = ("n/a", "na", "null", "none", "nan", "no output", "no answer", "no response", "empty", "blank", "boxed", "fbox")
_CLAUSE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_LETTERS = re.compile(r"(?<![\\a-z])[^\W\d_]{2,}")
_WORK = re.compile(r"\d\s*(?:[-+−*/^×·÷]|\\cdot|\\times)\s*\(?-?\d|=\s*\$?-?\d|<<")
_BOX = re.compile(r"\\f?boxed\s*\{\s*[^\s{}]")
_MACRO = re.compile(r"\\[a-z]+")
_NO_BOX = re.compile(r"boxed\s*\{\s*\}")
_BOLD = re.compile(r"^[*_]{2,}|[*_]{2,}$")
# Kinds of last characters.
_TAILS = {c: k for k, group in enumerate((".", "!?。！？", ":：", "=", "-+−*/×÷^·", "([{<\\", ")]}", "$", ",;，；", "_~#`\"'»”", "…", "0123456789"), 1) for c in group}
_BITS = 16
_HASHED = 1 << _BITS
_SHAPE = 192
FEATURES = _SHAPE + _HASHED
_MARGINS = np.array([-9.0, -4, -2, -0.7, 0.7, 2, 4, 9])
_MOST_WORDS = 300_000


class Vocabulary(dict):
    """Numbers of words, with the feature, the language scores and the kind of each; emptied when it has grown too large."""

    def __init__(self, languages: L.Languages) -> None:
        super().__init__()
        self.languages = languages
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.slot, self.number = np.zeros(0, np.int64), np.zeros(0, bool)
        self.score = np.zeros((0, len(L.NAMES)), np.float32)

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        self.fresh.append(word)
        return found

    def numbers(self, found: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        if self.fresh:
            new, self.fresh = self.fresh, []
            self.slot = np.append(self.slot, [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in new])
            self.number = np.append(self.number, [w.isdigit() for w in new])
            self.score = np.concatenate((self.score, self.languages.scores(new)))
        return out


def _member(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each key is among the known ones."""
    if not len(known):
        return np.zeros(len(keys), bool)
    known = np.unique(known)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys


def _share(hit: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    total = np.bincount(owner, minlength=n)
    return np.bincount(owner, weights=hit, minlength=n) / np.maximum(total, 1), total


def clauses_of(low: str) -> list[str]:
    """The clauses of a folded response; none if it has no letter or digit, is a placeholder or announces an empty box."""
    if " ".join(words(low)) in ("", *PLACEHOLDERS) or low.strip(" \t\r\n.-[]()<>") in PLACEHOLDERS:
        return []
    found = [p for p in (_BOLD.sub("", p.strip()).strip() for p in _CLAUSE.split(low)) if WORD.search(p)]
    return [] if "boxed" in low and all(map(_NO_BOX.search, found)) else found


class Pairs:
    """Clauses and features of a batch of pairs (question, response, whether the response is a bare result)."""

    def __init__(self, rows: list[tuple[str | None, str | None, bool]], vocabulary: Vocabulary) -> None:
        if len(vocabulary) > _MOST_WORDS:
            vocabulary.reset()
        parts: list[str] = []
        lengths, asked, asked_n = np.zeros(len(rows), np.int64), [], np.zeros(len(rows), np.int64)
        for i, (question, response, _) in enumerate(rows):
            found = clauses_of(folded(INVISIBLE.sub("", response))) if response else []
            if not found:
                continue
            parts += found
            lengths[i] = len(found)
            # A response without any word of two letters is neither echo nor of a language: its question isn't read.
            if question and any(map(_LETTERS.search, found)):
                w = WORD.findall(_MACRO.sub(" ", folded(question)))
                asked += w
                asked_n[i] = len(w)
        self.lengths, n = lengths, len(parts)
        split = [WORD.findall(_MACRO.sub(" ", p)) for p in parts]
        counts = np.array([len(w) for w in split], np.int64)
        self.sizes = np.maximum(counts, 1)
        ids = vocabulary.numbers([w for s in split for w in s])
        q = vocabulary.numbers(asked)
        pair = np.repeat(np.arange(len(rows)), lengths)
        clause = np.repeat(np.arange(n), counts)
        row, q_row = pair[clause], np.repeat(np.arange(len(rows)), asked_n)
        number = vocabulary.number[ids] if n else np.zeros(0, bool)
        wide = np.int64(len(vocabulary) + 1)
        asked_already = _member(row * wide + ids, q_row * wide + q)
        shared, _ = _share(asked_already, clause, n)
        next_to = np.flatnonzero(clause[1:] == clause[:-1])
        q_next = np.flatnonzero(q_row[1:] == q_row[:-1])
        # Pairs of neighbouring words by a 64-bit mix; the row takes part in it.
        couple = _mix(row[next_to], ids[next_to], ids[next_to + 1])
        echoed, couples = _share(_member(couple, _mix(q_row[q_next], q[q_next], q[q_next + 1])), clause[next_to], n)
        spoken = ~number & ~asked_already
        score = np.zeros((n, len(L.NAMES)))
        own = np.zeros((len(rows), len(L.NAMES)))
        for k in range(len(L.NAMES)):
            score[:, k] = np.bincount(clause[spoken], weights=vocabulary.score[ids[spoken], k], minlength=n)
            own[:, k] = np.bincount(q_row, weights=vocabulary.score[q, k] * ~vocabulary.number[q], minlength=len(rows))
        mine = own.argmax(axis=1)[pair]
        here = score[np.arange(n), mine]
        score[np.arange(n), mine] = -np.inf
        margin = score.max(axis=1, initial=-np.inf) - here if n else np.zeros(0)
        telling = (np.bincount(clause[spoken], minlength=n) > 0) & (asked_n[pair] > 0)
        self.other = telling & (margin > 0)
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        some = lengths > 0
        begin = (np.cumsum(lengths) - lengths)[some]
        first[begin] = True
        last[begin + lengths[some] - 1] = True
        short = np.array([bool(r[2]) for r in rows], bool)[pair]
        any_number = np.bincount(clause[number], minlength=n) > 0
        fresh_number = np.bincount(clause[number & ~asked_already], minlength=n) > 0
        text = np.array([(_TAILS.get(p[-1], 0) if p[-3:] != "..." else 11, _open(p), bool(_LETTERS.search(p)), bool(_WORK.search(p)), bool(_BOX.search(p))) for p in parts] or np.zeros((0, 5)), np.int64)
        tail, unpaired, lettered, work, box = text.T
        shape = [
            np.zeros(n, np.int64),
            1 + np.minimum(4, (shared * 5).astype(np.int64)),
            np.where(couples > 0, 7 + np.minimum(4, (echoed * 5).astype(np.int64)), 6),
            np.where(telling, 13 + np.searchsorted(_MARGINS, margin), 12),
            22 + tail,
            35 + unpaired,
            37 + lettered,
            39 + work,
            41 + box,
            43 + first,
            45 + last,
            47 + np.minimum(5, np.log2(self.sizes).astype(np.int64)),
            53 + short,
            55 + fresh_number,
            57 + 2 * short + last,
            np.where(last, 61 + tail, 74),
            75 + 4 * last + 2 * fresh_number + unpaired,
            83 + 8 * short + 4 * lettered + 2 * fresh_number + any_number,
            99 + 4 * last + 2 * work + box,
            np.where(last, 107 + 13 * unpaired + tail, 133),
            134 + 2 * np.minimum(4, (shared * 5).astype(np.int64)) + fresh_number,
            144 + 4 * np.minimum(4, (echoed * 5).astype(np.int64)) + 2 * self.other + work,
            164 + 8 * self.other + 4 * telling + 2 * lettered + short,
        ]
        other = self.other[clause]
        kept = np.flatnonzero(~asked_already & ~number)
        single = _SHAPE + _hashed(vocabulary.slot[ids[kept]], other[kept])
        ending = _SHAPE + _hashed(vocabulary.slot[ids[kept]], other[kept] + 2 + 2 * short[clause[kept]])
        at_end = last[clause[kept]]
        two = next_to[spoken[next_to] & spoken[next_to + 1]]
        double = _SHAPE + _hashed(vocabulary.slot[ids[two]] * 31 + vocabulary.slot[ids[two + 1]] * 17 + 7, other[two])
        owner = np.concatenate([np.tile(np.arange(n), len(shape)), clause[kept], clause[kept][at_end], clause[two]])
        flat = np.concatenate([*shape, single, ending[at_end], double]) if n else np.zeros(0, np.int64)
        by = np.argsort(owner, kind="stable")
        self.chains = Chains(flat[by], np.bincount(owner, minlength=n), lengths)

    def shares(self, chance: np.ndarray) -> np.ndarray:
        """What each tag covers of each pair: shares of all words, shares beside the echo, shares of the last clause, and 1."""
        some = np.flatnonzero(self.lengths)
        begin = self.chains.first[some]
        held = np.add.reduceat(chance * self.sizes[:, None], begin, axis=0) if len(some) else np.zeros((0, len(TAGS)))
        total = held.sum(axis=1, keepdims=True)
        rest = np.delete(held, ECHO, axis=1)
        out = [held / np.maximum(total, 1e-9), rest / np.maximum(rest.sum(axis=1, keepdims=True), 0.5), chance[begin + self.lengths[some] - 1], np.ones((len(some), 1))]
        return np.concatenate(out, axis=1)


def _open(part: str) -> bool:
    """Whether braces, parentheses or dollar signs of a clause are unpaired."""
    return part.count("{") != part.count("}") or part.count("(") != part.count(")") or (part.count("$") - part.count("\\$")) % 2 == 1


def _mix(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _hashed(slot: np.ndarray, kind: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (slot.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + kind.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - _BITS)).astype(np.int64)


class Model:
    """Field of the tags, regression of the defects and languages: what a fitted operator consists of."""

    def __init__(self, field: Field, decide: np.ndarray, languages: L.Languages) -> None:
        self.field, self.decide, self.languages = field, decide, languages
        self._vocabulary: Vocabulary | None = None

    def __getstate__(self) -> tuple:
        return self.field.weights.astype(np.float32), self.field.moves, self.decide, self.languages.table

    def __setstate__(self, state: tuple) -> None:
        field = Field(1, len(TAGS))
        field.weights, field.moves, decide, table = state
        self.__init__(field, decide, L.Languages(table))

    def read(self, rows: list[tuple[str | None, str | None, bool]]) -> Pairs:
        if self._vocabulary is None:
            self._vocabulary = Vocabulary(self.languages)
        return Pairs(rows, self._vocabulary)

    def defects(self, rows: list[tuple[str | None, str | None, bool]]) -> list[str | None]:
        """The defect of each pair, or None."""
        pairs = self.read(rows)
        out: list[str | None] = ["empty"] * len(rows)
        some = np.flatnonzero(pairs.lengths)
        if len(some):
            found = (pairs.shares(self.field.chances(pairs.chains)) @ self.decide).argmax(axis=1)
            for i, d in zip(some.tolist(), found.tolist(), strict=True):
                out[i] = DEFECTS[d]
        return out

    def tags(self, question: str | None, response: str | None, short: bool = False) -> list[str]:
        """The tag of each clause of a response."""
        pairs = self.read([(question, response, short)])
        return [TAGS[t] for t in self.field.decode(pairs.chains)] if pairs.chains.n else []


def _regression(x: np.ndarray, y: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Softmax regression of y on x, classes weighted alike, by Adagrad."""
    weights, held = np.zeros((x.shape[1], len(DEFECTS))), np.zeros((x.shape[1], len(DEFECTS)))
    target = np.eye(len(DEFECTS))[y]
    weight = (1 / np.maximum(np.bincount(y, minlength=len(DEFECTS)), 1))[y]
    weight[y == 0] *= 4
    weight = (weight / weight.sum())[:, None]
    for _ in range(steps):
        score = x @ weights
        chance = np.exp(score - score.max(axis=1, keepdims=True))
        gain = x.T @ ((target - chance / chance.sum(axis=1, keepdims=True)) * weight) - ridge * weights
        held += gain**2
        weights += 0.5 * gain / (np.sqrt(held) + 1e-9)
    return weights


def fit(rows: list[tuple[str | None, str | None, bool]], refusals: dict[str, list[str]] | None = None, seed: int = 11) -> Model:
    """A model from unrated pairs. Three quarters of the examples made from them fit the field, the others the regression."""
    from millrace.llm.defect_examples import examples

    texts = [words(t) for q, r, _ in rows for t in (q, r) if t]
    found = L.learn(texts)
    model = Model(Field(FEATURES, len(TAGS)), np.zeros((3 * len(TAGS), len(DEFECTS))), found)
    made = examples(rows, model, refusals, seed)
    field_part, other_part = [e for i, e in enumerate(made) if i % 4], made[::4]
    if not field_part or not other_part:
        return model
    pairs, labels, _ = labelled(field_part, model)
    # Work that breaks off is the end of a response, so no other tag follows on an unfinished clause.
    model.field.moves[UNFINISHED, :UNFINISHED] = -8.0
    # Every second clause hides its words, so that what it shares, its language and its shape carry to words not seen here.
    chains = pairs.chains
    keep = (chains.flat < _SHAPE) | np.repeat(np.random.default_rng(seed).random(chains.n) < 0.5, chains.counts)
    hidden = Chains(chains.flat[keep], np.add.reduceat(keep.astype(np.int64), chains.starts), chains.lengths)
    model.field.fit(hidden, labels, EPOCHS)
    pairs, _, defects = labelled(other_part, model)
    model.decide = _regression(pairs.shares(model.field.chances(pairs.chains)), defects)
    return model


def labelled(made: list, model: Model) -> tuple[Pairs, np.ndarray, np.ndarray]:
    """(pairs, tag of each clause, number of each defect) of examples (question, [(text, tag), ...], short, defect)."""
    rows, tags, defects = [], [], []
    for question, said, short, defect in made:
        known: list[int] = []
        for text, tag in said:
            # A bare value is of no language.
            known += [ANSWER if tag == FOREIGN and not _LETTERS.search(p) else tag for p in clauses_of(folded(text))]
        row = (question, "\n".join(t for t, _ in said), short)
        if known and len(known) == len(clauses_of(folded(row[1]))):
            rows.append(row)
            tags += known
            defects.append(DEFECTS.index(defect))
    return model.read(rows), np.array(tags, np.int64), np.array(defects, np.int64)


def chat_pair(messages: Column) -> tuple[Column, Column]:
    """(last user turn, content of the assistant turn after it or null) of a chat, with roles in any case."""

    def role(m: Column) -> Column:
        return F.lower(F.trim(F.coalesce(m["role"], F.lit(""))))

    spoken = F.filter(F.coalesce(messages, F.array().cast("array<struct<role:string,content:string>>")), lambda m: role(m).isin("user", "assistant"))
    question = F.try_element_at(F.filter(spoken, lambda m: role(m) == "user"), F.lit(-1))["content"]
    last = F.try_element_at(spoken, F.lit(-1))
    return question, F.when(role(last) == "assistant", last["content"])


def train(pairs: DataFrame, most: int = MOST_ROWS, longest: int = MOST_CHARS) -> Model:
    """The model, fitted on a seeded sample of at most `most` pairs (`question`, `response`, `short`) of texts up to `longest` characters.

    Both numbers bound what the driver holds; they bear on the sample only. Every pair is judged, whatever its length.
    """
    order = F.xxhash64(F.lit(11), "table_name", "id")
    # A threshold on the hash leaves about twice the sample, so that no task sends the driver more than its share.
    share = min(1.0, 2 * most / max(1, pairs.count()))
    fits = (F.length("response") <= longest) & (F.coalesce(F.length("question"), F.lit(0)) <= longest)
    likely = pairs.where((order <= F.lit(int(-(2**63) + share * (2**64 - 2**11)))) & fits)
    rows = likely.select("question", "response", "short", order.alias("o")).orderBy("o", "response", "question").limit(most).collect()
    return fit([(r.question, r.response, r.short) for r in rows])


def find_defects(pairs: DataFrame, model: Model) -> DataFrame:
    """`table_name`, `id`, `defect` of each defective pair (`table_name`, `id`, `question`, `response`, `short`).

    `short` marks responses that are bare results, which need no words that announce a result.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in pieces(batches, "response", most=2_000_000, rows=4000):
            out = judge.defects(list(zip(values(batch, "question"), values(batch, "response"), values(batch, "short"), strict=True)))
            keep = pa.array([i for i, d in enumerate(out) if d], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array([d for d in out if d], pa.string())], names=["table_name", "id", "defect"])

    return pairs.select("table_name", "id", "response", "question", "short").mapInArrow(run, "table_name string, id long, defect string").distinct()
