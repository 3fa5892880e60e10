"""Benchmark decontamination: one Aho-Corasick automaton over word windows, one scan of each text.

Texts and items are normalised alike: A-Z become lower case and every other ASCII
byte that is no letter or digit separates words. The automaton reads words, so a
text is scanned once whatever the number of windows, and a hit in words maps back
to code points of the original text.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reviewlake.llm.common import bounded_batches, fresh, written

#: Words of an item in one window.
WINDOW = 10
#: Item words in one automaton; a larger benchmark is scanned in blocks. A word makes at
#: most ten states, so an automaton takes up to 170 bytes a word.
BLOCK_WORDS = 250_000
#: Words of a piece of a long item; pieces overlap by a window less a word, so no window is lost.
PIECE_WORDS = 5_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TABLE = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WindowAutomaton:
    """Aho-Corasick over word numbers, in flat arrays of some 17 bytes a state.

    States are numbered breadth first, children by word: those of a state are
    ``first[state]`` to ``first[state + 1]``, and ``word`` is the one that leads to a
    state. ``longest`` is the length of the longest window that ends in a state,
    ``output`` its longest suffix that is a window (0: none), and a window's items are
    a slice of ``names``: lists are shared along the failure links, never copied.
    """

    def __init__(self, vocabulary: dict[bytes, int], windows: np.ndarray, owners: np.ndarray, names: list[str | None]) -> None:
        """``windows`` has a row of word numbers each, filled up with -1; ``owners`` their items' places in ``names``."""
        self.vocabulary = vocabulary
        width = max(1, len(vocabulary))
        lengths = (windows >= 0).sum(axis=1)
        at = np.zeros(len(windows), dtype=np.int64)
        levels, keys, states = [], [], 1
        for depth in range(windows.shape[1]):
            alive = np.flatnonzero(lengths > depth)
            key, to = np.unique(at[alive] * width + windows[alive, depth], return_inverse=True)
            at[alive] = states + to.reshape(-1)
            levels.append((states, states + len(key)))
            keys.append(key)
            states += len(key)
        key = np.concatenate([np.zeros(0, dtype=np.int64), *keys])  # ascending, as states are
        parent, word = np.r_[0, key // width], np.r_[-1, key % width]
        first = np.searchsorted(key // width, np.arange(states + 1)) + 1

        own = np.zeros(states, dtype=np.int64)
        own[at[lengths > 0]] = lengths[lengths > 0]
        fail, longest, output = np.zeros(states, dtype=np.int64), own.copy(), np.where(own > 0, np.arange(states), 0)
        for begin, end in levels:
            some = np.arange(begin, end)
            back, left = fail[parent[some]], np.arange(len(some)) if begin > 1 else np.zeros(0, dtype=np.int64)
            while len(left):
                wanted = back[left] * width + word[some[left]]
                place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                met = key[place] == wanted
                fail[some[left[met]]] = place[met] + 1
                left = left[~met & (back[left] > 0)]
                back[left] = fail[back[left]]
            longest[some] = np.maximum(own[some], longest[fail[some]])
            output[some] = np.where(own[some] > 0, some, output[fail[some]])

        named = sorted({(int(s), names[o]) for s, o in zip(at, owners) if s and names[o] is not None})
        self.names = [name for _, name in named]
        self.offsets = array("i", np.searchsorted([s for s, _ in named], np.arange(states + 1)).astype(np.int32).tobytes())
        self.first, self.word, self.fail, self.longest, self.output = (array("i", x.astype(np.int32).tobytes()) for x in (first, word, fail, longest, output))

    @classmethod
    def build(cls, items: Iterable[tuple[str | None, str | None]], window: int) -> WindowAutomaton:
        """The automaton of all windows of the items; one without a name adds its windows but no item."""
        vocabulary: dict[bytes, int] = {}
        names, parts, owners = [], [np.zeros((0, window), dtype=np.int32)], []
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
            if ids:
                ids += [-1] * (window - len(ids))
                parts.append(np.lib.stride_tricks.sliding_window_view(np.array(ids, dtype=np.int32), window))
                owners.append(np.full(len(parts[-1]), len(names), dtype=np.int32))
                names.append(item)
        return cls(vocabulary, np.concatenate(parts), np.concatenate([np.zeros(0, dtype=np.int32), *owners]), names)

    def items(self, state: int) -> Iterator[str]:
        """Items of all windows that end in a state."""
        state = self.output[state]
        while state:
            yield from self.names[self.offsets[state] : self.offsets[state + 1]]
            state = self.output[self.fail[state]]

    def scan(self, text_words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit word ranges (end exclusive, merged, ascending) and the items they come from."""
        first, labels, fail, longest = self.first, self.word, self.fail, self.longest
        hits: list[list[int]] = []
        ends: set[int] = set()
        state = 0
        for i, word in enumerate(map(self.vocabulary.get, text_words)):
            if word is None:
                state = 0
                continue
            while True:
                low, high = first[state], first[state + 1]
                if low < high and labels[low] != word:
                    low = bisect_left(labels, word, low + 1, high)
                if low < high and labels[low] == word:
                    state = low
                    break
                if not state:
                    break
                state = fail[state]
            if longest[state]:
                start = i + 1 - longest[state]
                while hits and hits[-1][1] >= start:
                    start = min(start, hits.pop()[0])
                hits.append([start, i + 1])
                ends.add(state)
        return hits, {item for state in ends for item in self.items(state)}


def merged(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def cutter(window: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Items as pieces of normalised words: every window lies in one of them."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for item, text in zip(frame["item"], frame["text"]):
                found = words(text)
                for i in range(0, max(1, len(found) - window + 1) if found else 0, PIECE_WORDS):
                    piece = found[i : i + PIECE_WORDS + window - 1]
                    yield pd.DataFrame({"item": [item], "text": [b" ".join(piece).decode("utf-8", "surrogatepass")], "n": len(piece)}).astype({"item": object, "text": object})

    return cut


def scanned(automaton: WindowAutomaton, texts: pd.Series, before: pd.Series, known: pd.Series) -> tuple[list, list]:
    """Hits and items of the texts, added to those of the blocks before."""
    hits, found = [], []
    for text, ranges, names in zip(texts, before, known):
        new, items = automaton.scan(words(text))
        hits.append(new if ranges is None or not len(ranges) else merged(new + [list(map(int, r)) for r in ranges]))
        found.append(sorted(items | set(names)))
    return hits, found


def scanner(shared: Broadcast) -> Callable[..., Column]:
    """Adds one automaton's hits and items to those of the blocks before."""

    @pandas_udf("hits array<array<int>>, items array<string>")
    def scan(texts: pd.Series, before: pd.Series, known: pd.Series) -> pd.DataFrame:
        hits, found = scanned(shared.value, texts, before, known)
        return pd.DataFrame({"hits": pd.Series(hits, dtype=object), "items": pd.Series(found, dtype=object)})

    return scan


def locator(shared: Broadcast) -> Callable[..., Column]:
    """The last block's scan, in the same worker as the places of all word ranges in the original text."""

    @pandas_udf("n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>")
    def locate(texts: pd.Series, before: pd.Series, known: pd.Series) -> pd.DataFrame:
        hits, found = scanned(shared.value, texts, before, known)
        spans = []
        for text, ranges in zip(texts, hits):
            at = [m.span() for m in _WORD.finditer(text)] if ranges else []
            spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges])
        return pd.DataFrame({
            "n_words": [len(words(t)) for t in texts],
            "n_hit": [sum(b - a for a, b in h) for h in hits],
            "items": pd.Series(found, dtype=object),
            "spans": pd.Series(spans, dtype=object),
        })

    return locate


def with_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    name: str,
    text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents with a struct column ``name``: ``n_words``, ``n_hit``, ``items`` (ids as sorted text), ``spans``.

    ``spans`` are the hit stretches in code points of the original text, the end
    exclusive. Null texts have no words; null items and items without words have no
    windows; the windows of an item without an id make hits, but it has no name to be
    listed by. Repeated rows are scanned each; empty tables give no rows or no hits;
    other columns pass through. Long items are cut into pieces that overlap, and the
    pieces dealt into blocks of bounded size; the texts meet one automaton per block.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    pieces = written(items.where("text is not null").mapInPandas(cutter(window), "item string, text string, n bigint"), "items")
    blocks = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block_words))

    found = fresh(documents, "found")
    text = F.col(text_col).cast("string")
    frame = documents.withColumn(
        found, F.struct(F.lit(None).cast("array<array<int>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    )
    for block in range(blocks):
        rows = pieces.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).toLocalIterator()
        shared = spark.sparkContext.broadcast(WindowAutomaton.build(((r.item, r.text) for r in rows), window))
        before = (text, F.col(f"{found}.hits"), F.col(f"{found}.items"))
        if block == blocks - 1:
            return frame.withColumn(name, locator(shared)(*before)).drop(found)
        frame = written(frame.withColumn(found, scanner(shared)(*before)), "leaks")
    raise AssertionError("a benchmark has at least one block")


def find_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """Per document: id, ``n_words``, ``n_hit``, ``items``, ``spans``, as :func:`with_leaks` gives them."""
    narrow = documents.select(documents[id_col].alias("id"), documents[text_col].alias("text"))
    located = with_leaks(narrow, benchmark, "leaks", "text", **options)
    return located.select(F.col("id").alias(id_col), "leaks.n_words", "leaks.n_hit", "leaks.items", "leaks.spans")
