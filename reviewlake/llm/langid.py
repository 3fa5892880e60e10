"""Language ID by prediction by partial matching over bytes.

Every language has a tree of byte contexts up to four bytes long. A byte costs
-log2 of its share in the longest context where it was seen; each longer context
that exists without it adds its escape cost (method C: a context seen n times
with d different bytes predicts a byte seen c times with c/(n+d) and escapes with
d/(n+d)); below the empty context all 256 bytes are equal. Statistics are frozen
after fitting, so the cost of every seen context-and-byte is worked out once, with
its escapes, for all languages; scoring a text is table look-ups over all its
bytes and a sum per language, which is the exact code length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reviewlake.llm.common import bounded_batches, chunks, collected, fold, plain, run_starts

#: Bytes of context and byte together in the longest context.
WIDTH = 5
#: Texts of each language the trees are fitted on, about: those of smallest hash.
MAX_TEXTS = 1000
#: Bytes scored at a time.
CHUNK = 1 << 18
_PAD = b"\0" * (WIDTH - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


class KeyTable:
    """Numbers of known 64-bit keys, looked up for whole arrays (open addressing)."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.numbers = np.full(1 << bits, -1, dtype=np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slots = self.home(keys)
        while len(left):
            free = self.numbers[slots] < 0
            self.numbers[slots[free]] = left[free]  # of several the last one stays
            won = self.numbers[slots] == left
            self.keys[slots[won]] = keys[left[won]]
            left, slots = left[~won], (slots[~won] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is unknown."""
        slots = self.home(keys)
        out = self.numbers[slots]
        again = np.flatnonzero((out >= 0) & (self.keys[slots] != keys))
        slots = slots[again]
        while len(again):
            slots = (slots + 1) & self.mask
            number = self.numbers[slots]
            out[again] = number
            more = (number >= 0) & (self.keys[slots] != keys[again])
            again, slots = again[more], slots[more]
        return out


def packed(data: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The ``width`` bytes that end at each position from ``width - 1`` on, as one number."""
    out = np.zeros(len(data) - width + 1, dtype=np.uint64)
    for j in range(width):
        out = (out << np.uint64(8)) | data[j : j + len(out)]
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all byte windows of some texts, each padded in front, and each text's first."""
    data = np.frombuffer(b"".join(_PAD + t for t in texts), dtype=np.uint8)
    keys = packed(data)
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(np.r_[0, lengths[:-1] + WIDTH - 1])
    keep = np.ones(len(keys), dtype=bool)
    for j in range(WIDTH - 1):  # windows that end in the padding of a later text
        at = starts[1:] - 1 - j
        keep[at[at >= 0]] = False
    return keys[keep], np.cumsum(np.r_[0, lengths[:-1]])


def normalised(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


@dataclass
class Trees:
    """Costs in bits by language (columns), for windows of each width and escapes of each context."""

    languages: list[str]
    tables: dict[int, KeyTable]
    costs: dict[int, np.ndarray]
    contexts: dict[int, KeyTable]
    escapes: dict[int, np.ndarray]

    @classmethod
    def fit(cls, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Trees:
        """``counts`` has each language's different windows of WIDTH bytes and how often they occur."""
        n = len(languages)
        self = cls(languages, {}, {}, {}, {})
        for width in range(1, WIDTH + 1):
            mask = np.uint64((1 << 8 * width) - 1)
            grams = []
            for keys, number in counts:
                gram, at = np.unique(keys & mask, return_inverse=True)
                grams.append((gram, np.bincount(at.reshape(-1), weights=number, minlength=len(gram))))
            context_keys = np.unique(np.concatenate([g >> np.uint64(8) for g, _ in grams]))
            escape = np.zeros((len(context_keys), n))
            union = np.unique(np.concatenate([g for g, _ in grams]))
            own = np.full((len(union), n), np.nan)
            for k, (gram, number) in enumerate(grams):
                context = gram >> np.uint64(8)
                first = run_starts(context)
                total = np.add.reduceat(number, first)
                different = np.diff(np.r_[first, len(gram)])
                escape[np.searchsorted(context_keys, context[first]), k] = np.log2((total + different) / different)
                spread = np.repeat(total + different, different)
                own[np.searchsorted(union, gram), k] = np.log2(spread / number)
            self.contexts[width], self.escapes[width] = KeyTable(context_keys), escape.astype(np.float32)
            lower = self.escaped(union, width).astype(np.float64)
            self.costs[width] = np.where(np.isnan(own), lower, own).astype(np.float32)
            self.tables[width] = KeyTable(union)
        return self

    def escaped(self, keys: np.ndarray, width: int) -> np.ndarray:
        """Cost where the window of this width is unknown: escape, then the shorter context."""
        at = self.contexts[width].find(keys >> np.uint64(8))
        cost = np.where((at >= 0)[:, None], self.escapes[width][at], np.float32(0))
        if width == 1:
            return cost + np.float32(8)
        return cost + self.cost(keys & np.uint64((1 << 8 * (width - 1)) - 1), width - 1)

    def cost(self, keys: np.ndarray, width: int = WIDTH) -> np.ndarray:
        """Bits of the last byte of each window, a column per language."""
        at = self.tables[width].find(keys)
        out = self.costs[width][at]
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            out[unknown] = self.escaped(keys[unknown], width)
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text (rows) in each language (columns)."""
        out = np.zeros((len(texts), len(self.languages)))
        for a, b in chunks(texts, CHUNK):
            some = [i for i in range(a, b) if texts[i]]
            if not some:
                continue
            keys, starts = joined([texts[i] for i in some])
            if len(some) > 1:
                out[some] = np.add.reduceat(self.cost(keys), starts, axis=0, dtype=np.float64)
            else:  # a long text piece by piece
                for i in range(0, len(keys), CHUNK):
                    out[some[0]] += self.cost(keys[i : i + CHUNK]).sum(axis=0, dtype=np.float64)
        return out


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_texts: int = MAX_TEXTS) -> Trees:
    """Trees of every language among the learnable rows (text and language known, id's crc32 mod 3 not 1).

    About ``max_texts`` texts of each language, chosen by hash, are read whole;
    their windows are counted by Spark, and only the counts come to the driver.
    """
    rows = df.select(
        df[id_col].alias("id"), df[text_col].cast("string").alias("text"), df[lang_col].cast("string").alias("lang")
    ).where((fold(F.col("id")) != 1) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    known = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not known:
        return Trees([], {}, {}, {}, {})
    share = F.lit(0.0)
    for lang, n in known.items():
        share = F.when(F.col("lang") == lang, F.lit(max_texts / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, group in frame.groupby("lang"):
                texts = [normalised(t) for t in group["text"] if t]
                for a, b in chunks(texts, CHUNK):
                    keys, number = np.unique(joined(texts[a:b])[0], return_counts=True)
                    yield plain(pd.DataFrame({"lang": lang, "key": keys.astype(np.int64), "n": number}))

    windows = rows.where(draw < share).mapInPandas(count, "lang string, key bigint, n bigint")
    found = collected(windows.groupBy("lang", "key").agg(F.sum("n").alias("n")))
    groups = {lang: g.sort_values("key") for lang, g in found.groupby("lang")}
    languages = sorted(groups)
    if not languages:
        return Trees([], {}, {}, {}, {})
    return Trees.fit(languages, [(groups[x]["key"].to_numpy().astype(np.uint64), groups[x]["n"].to_numpy(dtype=float)) for x in languages])


def language(trees: Trees, df: DataFrame, text_col: str = "text") -> Column:
    """A struct column: ``lang_pred``, ``score`` and ``bits_per_byte`` of each text.

    ``lang_pred`` is ``und`` and the score 0 for texts that are null or have no
    letter, and for all texts if no language was learned. The score is the share of
    the best language if each had 16 bytes of the text's mean cost to its name.
    Equal code lengths go to the first language in alphabetical order.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(trees)

    @pandas_udf("lang_pred string, score double, bits_per_byte double")
    def identify(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        data = [normalised(t) if t and any(map(str.isalpha, t)) else b"" for t in texts]
        if not model.languages:
            return pd.DataFrame({"lang_pred": "und", "score": 0.0, "bits_per_byte": np.nan}, index=texts.index)
        length = np.array([len(t) for t in data])
        mean = model.bits(data) / np.maximum(length, 1)[:, None]
        best = mean.argmin(axis=1)
        least = mean[np.arange(len(mean)), best]
        score = 1 / np.exp2(-16 * (mean - least[:, None])).sum(axis=1)
        empty = length == 0
        names = np.array([*model.languages, "und"], dtype=object)
        return pd.DataFrame(
            {
                "lang_pred": names[np.where(empty, len(model.languages), best)],
                "score": np.where(empty, 0.0, score),
                "bits_per_byte": np.where(empty, np.nan, least),
            },
            index=texts.index,
        )

    return identify(df[text_col].cast("string"))
