r"""Personal data, and the terms that give it away.

Base spans (mail and network addresses, card and phone numbers) are found by
pattern. Each different one is a protected entity c with the information content
IC(c) = -log2 p(c). A term t discloses of it the pointwise mutual information
PMI(c; t) = log2 p(c, t) / (p(c) p(t)); the share PMI/IC is 1 where the term
occurs with nobody else. Probabilities are corpus counts of passages: of all
passages, of those with the entity, of those with the term, and of those where
the term stands near the entity. A term whose share reaches the threshold for
some entity is replaced by a general form that stays below it for all of them,
or removed if there is none.

Terms and entities are known by 64-bit hashes; all counts are Spark aggregates.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reviewlake.llm.common import bounded_batches, fresh, if_small, written

# Kinds in their order, and the shapes of the base spans.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile("[^0-9]")
_ASCII_DIGIT = re.compile("[0-9]")

_TERM = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_DIGIT = re.compile(r"\d")
#: Kinds of the spans the method adds.
GENERAL, REMOVE = "generalise", "remove"
#: Share of an entity's information from which a term discloses it, and different surroundings needed to say so.
DISCLOSURE, SUPPORT = 0.9, 3
#: Terms to either side of an entity that stand near it, and the least characters of a term.
NEAR, LEAST_CHARS = 8, 3
#: Code points of a passage, the unit that is counted; most texts are one.
PASSAGE = 1 << 16
#: Words whose hashes a task remembers, and counts it holds before it passes them on.
REMEMBERED = 1 << 19
#: Terms that one scan of the texts looks for (some 100 bytes each); more are looked for block by block.
BLOCK_TERMS = 500_000
_KEPT_LETTERS = 3

Span = tuple[int, int, str]


def mail_spans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted name, in time linear in the text.

    A match starts where the run of local characters before its @ does, or where the
    match before ended; a run without a name behind its @ holds no match.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        name = _DOMAIN.match(text, at + 1)
        if name:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = name.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """``start, end, kind`` of all base spans, by start and then kind."""
    found = [(a, b, 0) for a, b in mail_spans(text)] if "@" in text else []
    digit = _ASCII_DIGIT.search(text)
    if digit is None:
        return [(a, b, KINDS[0]) for a, b, _ in found]
    first = digit.start()
    for m in _IP.finditer(text, first):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((*m.span(), 1))
    for m in _CARD.finditer(text, first):
        if m.end() - m.start() >= 12:
            digits = _NO_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
            found.append((*m.span(), 3))
    found.sort(key=lambda s: (s[0], s[2]))
    return [(a, b, KINDS[k]) for a, b, k in found]


def hashed(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def entity(kind: str, text: str) -> int:
    """An entity is its kind and its value without case or punctuation."""
    return hashed(f"{kind}:{text.lower() if kind in ('email', 'ip') else _NO_DIGIT.sub('', text)}")


def general_form(word: str) -> str:
    """What a term is generalised to: its form of digits, or its first letters; empty if there is nothing more general."""
    if _DIGIT.search(word):
        return "#" + _DIGIT.sub("0", word)
    return word[:_KEPT_LETTERS] + "*" if len(word) > _KEPT_LETTERS else ""


class Terms:
    """Hashes of terms and of their general forms (0: none), remembered for words seen lately."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, word: str) -> tuple[int, int]:
        pair = self.known.get(word)
        if pair is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            low = word.lower()
            form = general_form(low)
            pair = self.known[word] = (hashed(low), hashed(form) if form else 0)
        return pair


def terms_outside(text: str, spans: list[Span]) -> Iterator[tuple[int, int]]:
    """Start and end of every term that touches no base span."""
    merged: list[list[int]] = []
    for a, b, _ in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    k = 0
    for m in _TERM.finditer(text):
        a, b = m.span()
        if b - a < LEAST_CHARS:
            continue
        while k < len(merged) and merged[k][1] <= a:
            k += 1
        if k == len(merged) or merged[k][0] >= b:
            yield a, b


def passage_terms(text: str) -> Iterator[set[str]]:
    """The different terms of each passage of a text; one that has them begins in it."""
    spans = base_spans(text)
    if not spans and len(text) <= PASSAGE:
        yield {w for w in set(_TERM.findall(text)) if len(w) >= LEAST_CHARS}
        return
    passage, held = 0, set()
    for a, b in terms_outside(text, spans):
        if a // PASSAGE != passage:
            yield held
            held, passage = set(), a // PASSAGE
        held.add(text[a:b])
    yield held


def near_terms(text: str, known: Terms) -> Iterator[set[tuple[int, int, int, int]]]:
    """For each passage of a text the different ``entity, term, general, surroundings`` in it.

    An entity is listed as a term of its own, so that its passages are counted too.
    """
    spans = base_spans(text)
    if not spans:
        return
    starts, ends = array("q"), array("q")
    for a, b in terms_outside(text, spans):
        starts.append(a)
        ends.append(b)
    found: set[tuple[int, int, int, int]] = set()
    passage = spans[0][0] // PASSAGE
    for a, b, kind in spans:
        if a // PASSAGE != passage:
            yield found
            found, passage = set(), a // PASSAGE
        own = entity(kind, text[a:b])
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        around = [text[starts[i] : ends[i]] for i in (*range(max(0, before - NEAR), before), *range(after, min(len(starts), after + NEAR)))]
        place = hashed(" ".join(around).lower())
        found.add((own, own, 0, place))
        for word in around:
            term, general = known.of(word)
            found.add((own, term, general, place))
            if general:
                found.add((own, general, 0, place))
    yield found


def evidence(texts: DataFrame) -> DataFrame:
    """``entity, term, general, n, places``: passages where they stand together, and different surroundings."""

    def collect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Terms()
        for frame in frames:
            for text in frame["text"]:
                for found in near_terms(text, known):
                    at = pd.DataFrame(np.array(list(found), dtype=np.int64), columns=["entity", "term", "general", "place"])
                    # A pair that a passage has in several places is counted there once.
                    yield at.assign(n=(~at.duplicated(["entity", "term"])).astype(np.int64))

    some = texts.where(F.col("text").rlike("[@0-9]"))
    rows = some.mapInPandas(collect, "entity bigint, term bigint, general bigint, place bigint, n bigint")
    # By place first: a pair of a hot entity is spread over as many rows as it has surroundings.
    places = rows.groupBy("entity", "term", "general", "place").agg(F.sum("n").alias("n"))
    return places.groupBy("entity", "term", "general").agg(F.sum("n").alias("n"), F.count("*").alias("places"))


def term_passages(texts: DataFrame) -> DataFrame:
    """``term, n``: passages that hold each term or general form, counted in every task before they are passed on."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = Terms(), Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"term": np.fromiter(counts.keys(), np.int64, len(counts)), "n": np.fromiter(counts.values(), np.int64, len(counts))})
            counts.clear()
            return out

        for frame in frames:
            for text in frame["text"]:
                for words in passage_terms(text):
                    held = {h for pair in map(known.of, words) for h in pair}
                    held.discard(0)
                    counts.update(held)
                if len(counts) >= REMEMBERED:
                    yield flush()
        if counts:
            yield flush()

    return texts.mapInPandas(count, "term bigint, n bigint")


def disclosing_terms(
    documents: DataFrame, text_col: str = "text", threshold: float = DISCLOSURE, support: int = SUPPORT
) -> DataFrame:
    """``term, general, disclosure, action`` of every term that reveals a protected entity.

    ``disclosure`` is the largest share PMI/IC over all entities the term stands near,
    in at least ``support`` different surroundings: copies of a passage are one.
    ``action`` is ``generalise`` where the general form's share stays below the
    threshold for all those entities, else ``remove``. Texts of all rows are counted,
    repeated rows each; null and empty texts hold nothing; an entity in every passage
    has no information to disclose. Empty tables give no rows.
    """
    bounded_batches(documents.sparkSession)
    texts = documents.select(documents[text_col].cast("string").alias("text")).where(F.col("text") != "")
    pairs = written(evidence(texts).where((F.col("places") >= support) | (F.col("entity") == F.col("term"))), "near-terms")
    entities = pairs.where("entity = term").select("entity", F.col("n").alias("n_entity"))
    near = pairs.where((F.col("entity") != F.col("term")) & (F.col("places") >= support))
    wanted = written(near.select("term").distinct(), "wanted-terms")
    counts = term_passages(texts).join(if_small(wanted), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_term"))
    counts = written(counts, "term-passages")
    passages = texts.agg(F.sum(F.ceil(F.length("text") / PASSAGE))).first()[0] or 0

    # Passages with both over passages with the term: what the term says of the entity.
    information = F.log2(F.lit(float(passages)) / F.col("n_entity"))
    mutual = F.log2(F.lit(float(passages)) * F.col("n") / (F.col("n_entity") * F.col("n_term")))
    share = F.when(information > 0, F.least(F.lit(1.0), mutual / information)).otherwise(0.0)
    rated = near.join(entities, "entity").join(counts, "term").select("entity", "term", "general", share.alias("disclosure"))
    rated = written(rated, "rated-terms")
    forms = rated.select("entity", F.col("term").alias("general"), F.col("disclosure").alias("of_general"))
    told = rated.where(F.col("disclosure") >= threshold).join(forms, ["entity", "general"], "left")
    # General forms are counted like terms but stand in no text.
    of_words = told.join(rated.where("general <> 0").select(F.col("general").alias("term")).distinct(), "term", "left_anti")
    safe = F.max(F.coalesce("of_general", F.lit(1.0))) < threshold
    return of_words.groupBy("term").agg(
        F.max("general").alias("general"), F.max("disclosure").alias("disclosure"), F.when(safe, GENERAL).otherwise(REMOVE).alias("action")
    )


def finder(shared: Broadcast, first: bool) -> Column:
    """Base spans (in the ``first`` scan) and those of a block of disclosing terms, added to the spans found before."""

    @pandas_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def find(texts: pd.Series, before: pd.Series) -> pd.Series:
        actions, known, out = shared.value, Terms(), []
        order = {k: i for i, k in enumerate((*KINDS, GENERAL, REMOVE))}
        for text, spans in zip(texts, before):
            # Most texts have no disclosing term; places are looked for in the others only.
            told = actions and any(known.of(w)[0] in actions for w in set(_TERM.findall(text)))
            base = base_spans(text) if first or told else []
            all_spans = [(s["start"], s["end"], s["kind"]) for s in spans] + (base if first else [])
            if told:
                for a, b in terms_outside(text, base):
                    action = actions.get(known.of(text[a:b])[0])
                    if action:
                        all_spans.append((a, b, action))
                all_spans.sort(key=lambda s: (s[0], order[s[2]]))
            out.append([{"kind": k, "start": a, "end": b} for a, b, k in all_spans])
        return pd.Series(out, index=texts.index, dtype=object)

    return find


def find_personal(
    documents: DataFrame, name: str = "spans", text_col: str = "text", terms: DataFrame | None = None, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """The documents with ``name``, the list of (kind, start, end) of all base spans and of all disclosing terms.

    ``terms`` are those of :func:`disclosing_terms`; by default the documents' own.
    Spans are sorted by start, then kind; offsets are code points, the end exclusive.
    A null text is empty and has no spans; repeated rows are scanned each, texts
    whole; empty tables give no rows; other columns pass through whatever their names.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    terms = written(disclosing_terms(documents, text_col) if terms is None else terms, "disclosing-terms")
    blocks = max(1, -(-terms.count() // block_terms))
    text, found = F.coalesce(documents[text_col].cast("string"), F.lit("")), fresh(documents, "found")
    frame = documents.withColumn(found, F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    for block in range(blocks):
        rows = terms.where(F.pmod("term", F.lit(blocks)) == block).select("term", "action").toLocalIterator()
        shared = spark.sparkContext.broadcast({r.term: r.action for r in rows})
        frame = frame.withColumn(found, finder(shared, block == 0)(text, F.col(found)))
        if blocks > 1:
            frame = written(frame, "personal")
            text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    columns = [F.col(c) for c in documents.columns if c.lower() != name.lower()]
    return frame.select(*columns, F.col(found).alias(name))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with base spans replaced by their kind, terms by their general form, and removed terms by a dash.

    Spans that overlap are one: the first names it, the furthest ends it. A null text stays null.
    """

    @pandas_udf("string")
    def clean(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for value, found in zip(texts, lists):
            if value is None or found is None or not len(found):
                out.append(value)
                continue
            parts, done, last = [], 0, 0
            for s in found:
                a, b, kind = s["start"], s["end"], s["kind"]
                if a >= done:
                    word = value[a:b]
                    parts += [value[last:a], general_form(word).lstrip("#") if kind == GENERAL else "-" if kind == REMOVE else f"[{kind}]"]
                done = last = max(done, b)
            out.append("".join([*parts, value[last:]]))
        return pd.Series(out, index=texts.index, dtype=object)

    return clean(text.cast("string"), spans)
