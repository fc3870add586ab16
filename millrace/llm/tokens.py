"""Problem 6: token counts under an existing merge table.

A prefix trie of distinct pieces holds at each node the exact tokenization of its prefix, as the length of its last token and the
number of tokens; the node before the last token holds the rest. A longer prefix needs one search for the token that ends it, so
shared prefixes are tokenized once.

`count_tokens` keeps a trie and the counts of its pieces in each task and looks them up there: nothing is shuffled. `count_pieces`
counts each distinct piece of all documents once, in tries partitioned by prefix, and joins the counts to the documents: less
tokenizing where pieces are dear, for the price of moving the pieces. Both give the same numbers.

Defined results: a null or empty text has 0 tokens; a piece may be as long as its text; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import keyed, pieces, values
from millrace.llm.text import LONG_TEXT
from millrace.storage import materialise

#: Runs: letters, up to three digits or other marks, each with one leading space at the most; white space; underscores.
RUN = re.compile(r" ?[^\W\d_]+| ?\d{1,3}| ?[^\w\s]+|\s+|_+")
#: Pieces longer than this are counted by a heap of their own and not kept.
LONG_PIECE = 256


#: Known neighbours that are kept.
MOST_PAIRS = 2_000_000


class Tokenizer:
    """Counts tokens of pieces under merges (left, right) in the order of their rank."""

    def __init__(self, merges: list[tuple[str, str]], most_nodes: int = 1_000_000) -> None:
        self.rank = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        joined = {a + b for a, b in merges}
        self.known = {t for t in joined if len(self.tokens(t)) == 1}
        self.longest = max(map(len, self.known), default=1)
        self.most_nodes = most_nodes
        self.pairs: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        """An empty trie: `child` leads from (node, character) to a node; each node has the size of its last token and the number of tokens."""
        self.child: dict[int, int] = {}
        self.size, self.number = [0], [0]

    def tokens(self, piece: str) -> list[str]:
        """The tokens of a piece, by joining the pair of least rank again and again, the leftmost first."""
        found = list(piece)
        while len(found) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(found, found[1:], strict=False)]
            least = min(ranks)
            if least == 1 << 60:
                break
            out, i = [], 0
            while i < len(found):
                if i + 1 < len(found) and ranks[i] == least:
                    out.append(found[i] + found[i + 1])
                    i += 2
                else:
                    out.append(found[i])
                    i += 1
            found = out
        return found

    def follows(self, a: str, b: str) -> bool:
        """Whether the tokens a and b stand side by side when they are all of a piece."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.tokens(a + b) == [a, b]
        return known

    def last_token(self, piece: str, end: int, size_at: Callable[[int], int]) -> int:
        """The length of the token that ends the prefix of that length, 0 if there is none; `size_at` tells it of shorter prefixes."""
        for size in range(min(self.longest, end), 0, -1):
            token = piece[end - size : end]
            if size > 1 and token not in self.known:
                continue
            begin = end - size
            if begin == 0 or self.follows(piece[begin - size_at(begin) : begin], token):
                return size
        return 0

    def count(self, piece: str) -> int:
        """The number of tokens of a piece, from its longest prefix in the trie on."""
        if len(self.size) > self.most_nodes:
            self.clear()
        path = [0]
        for c in piece:
            if (node := self.child.get(path[-1] << 21 | ord(c))) is None:
                break
            path.append(node)
        for end in range(len(path), len(piece) + 1):
            size = self.last_token(piece, end, lambda at: self.size[path[at]])
            if not size:
                return len(self.tokens(piece))
            node = self.child[path[-1] << 21 | ord(piece[end - 1])] = len(self.size)
            self.size.append(size)
            self.number.append(self.number[path[end - size]] + 1)
            path.append(node)
        return self.number[path[-1]]


class Counts(dict):
    """Token counts of pieces, kept while they fit."""

    def __init__(self, tokenizer: Tokenizer, most: int = 500_000) -> None:
        super().__init__()
        self.tokenizer, self.most = tokenizer, most

    def __missing__(self, piece: str) -> int:
        if len(piece) > LONG_PIECE:
            return long_count(self.tokenizer, piece)
        if len(self) >= self.most:
            self.clear()
        found = self[piece] = self.tokenizer.count(piece)
        return found


def long_count(tokenizer: Tokenizer, piece: str) -> int:
    """The trie's step along one long piece, with arrays in place of prefixes: time and memory in proportion to its length."""
    lengths, numbers = [0], [0]
    for end in range(1, len(piece) + 1):
        size = tokenizer.last_token(piece, end, lengths.__getitem__)
        if not size:
            return len(tokenizer.tokens(piece))
        lengths.append(size)
        numbers.append(numbers[end - size] + 1)
    return numbers[-1]


def text_tokens(text: str | None, of: Callable[[str], int]) -> int:
    if not text:
        return 0
    return sum(map(of, RUN.findall(text))) if len(text) < LONG_TEXT else sum(of(m.group()) for m in RUN.finditer(text))


def read_merges(merges: DataFrame, most: int = 1_000_000) -> list[tuple[str, str]]:
    """The merge table (`merge_rank`, `left_piece`, `right_piece`) in order; a vocabulary has a bounded number of rows, which is checked."""
    rows = merges.select("merge_rank", "left_piece", "right_piece").dropna().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a merge table of more than {most} rows")
    return [(r.left_piece, r.right_piece) for r in sorted(rows, key=lambda r: r.merge_rank)]


def count_tokens(records: DataFrame, merges: list[tuple[str, str]], others: list[str] = ()) -> DataFrame:
    """`id`, the columns named in `others`, and `n_tokens` of each row of records (`id`, `text`)."""
    spark = records.sparkSession
    shared = spark.sparkContext.broadcast(merges)
    kept = ["id", *others]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Counts(Tokenizer(shared.value)).__getitem__
        for batch in pieces(batches, "text"):
            n = [text_tokens(t, of) for t in values(batch, "text")]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=[*kept, "n_tokens"])

    source = keyed(records, *others)
    schema = source.drop("text").schema.add("n_tokens", "long")
    return source.mapInArrow(scan, schema)


def _pieces_scan(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Counts(Tokenizer(shared.value))
        for batch in pieces(batches, "text"):
            ids, found, times = [], [], []
            for key, text in zip(values(batch, "id"), values(batch, "text"), strict=True):
                for piece, n in Counter(m.group() for m in RUN.finditer(text or "")).items():
                    long = len(piece) > LONG_PIECE
                    ids.append(key)
                    found.append(None if long else piece)
                    times.append(n * long_count(of.tokenizer, piece) if long else n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(times, pa.int64())], names=["id", "piece", "times"])

    return scan


def count_pieces(records: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """`id`, `n_tokens` of records (`id`, `text`) by distinct pieces; the rows of a repeated id are summed.

    Pieces are partitioned by their first characters and sorted, so that a task's trie holds neighbours; pieces of more than LONG_PIECE
    characters are counted where they stand. A frequent piece is counted once and its rows are summed by document before and after the join.
    """
    shared = records.sparkSession.sparkContext.broadcast(merges)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value)
        for batch in batches:
            n = [tokenizer.count(p) for p in values(batch, "piece")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["piece", "tokens"])

    source = keyed(records)
    held = materialise(source.mapInArrow(_pieces_scan(shared), "id long, piece string, times long"), "pieces")
    distinct = held.where("piece IS NOT NULL").select("piece").distinct()
    counted = distinct.repartition(F.substring("piece", 1, 4)).sortWithinPartitions("piece").mapInArrow(count, "piece string, tokens long")
    joined = held.join(counted, "piece", "left").select("id", (F.col("times") * F.coalesce("tokens", F.lit(1))).alias("n"))
    none = source.select("id", F.lit(0).cast("long").alias("n"))
    return joined.unionByName(none).groupBy("id").agg(F.sum("n").alias("n_tokens"))
