"""Toxicity by a weighted finite-state grammar over the words of a clause.

Five transducers read one clause: negation, reported speech, target, insult and
threat. Each rewrites word classes in the light of what stands before them; the
composition of all five is one deterministic machine with a weight per step, and a
clause's score is the sum of the weights on its path times the strength of the
words that earned them. An insult counts more when somebody is addressed, less
when it is negated or only reported; a verb of violence counts only when it is
intended or aimed at somebody.

The grammar is fixed. Which words and word beginnings are insults, and how strong
they are, is learned from labelled rows on top of a seed list, as are the weights
that turn the clause scores of a text into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reviewlake.llm.common import bounded_batches, collected, fold

#: Labelled rows of each label that are learned from, about: those of smallest hash.
MAX_LABELLED = 3000
#: Beginnings of words considered as insult stems, in letters.
STEMS = range(4, 8)
#: Toxic texts with a term before it counts as evidence.
MIN_SUPPORT = 4
#: Strength from which a learned term counts as an insult; from which a word supports a beginning; words it takes.
MIN_STRENGTH, MIN_EVIDENCE, STEM_WORDS = 1.8, 0.7, 3
SEED_STRENGTH = 4.0

# Seed words of each class.
INSULTS = (
    "idiot idiots moron morons imbecile stupid dumb dumbass loser losers trash garbage scum vermin worthless pathetic "
    "disgusting clown fool bastard bitch asshole jerk pig swine filth retard retarded degenerate "
    "dummkopf arschloch abschaum schwein versager widerlich connard salaud salope crétin abruti ordure débile "
    "idiota imbécil estúpido estúpida basura escoria asqueroso cabrón gilipollas pendejo"
)
VIOLENCE = (
    "kill murder hurt beat stab shoot strangle destroy burn hang rape attack töten umbringen verletzen schlagen "
    "tuer frapper détruire brûler matar golpear destruir quemar"
)
INTENT = "will gonna going shall i'll we'll werde werden vais allons voy vamos"
TARGETS = (
    "you your you're yours u ur he she him her they them these those people du dich dir ihr euch sie tu toi te vous "
    "eres usted ustedes tú ti vosotros"
)
NEGATIONS = "not no never don't isn't aren't wasn't nicht kein keine nie niemals pas jamais nunca jamás"
REPORTING = "said says say called calls quoted quotes wrote reported claims claimed sagte sagt dit disait dijo dice"

OTHER, INSULT, VIOLENT, INTENDED, TARGET, NEGATION, REPORT = range(7)
SEEDS = {
    word: kind
    for kind, words in (
        (INSULT, INSULTS), (VIOLENT, VIOLENCE), (INTENDED, INTENT), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTING),
    )
    for word in words.split()
}

_CLAUSE = re.compile(r"[.!?;\n…]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: ``step(state, symbol)`` gives the next state and the symbol written.

    Symbols are (word class, weight): a transducer may change the weight.
    """

    states: int
    step: object


def _window(trigger: int, reach: int, affected: tuple[int, ...], factor: float) -> Transducer:
    """After ``trigger`` the next ``reach`` words of the affected classes have their weight multiplied."""

    def step(state: int, symbol: tuple[int, float]) -> tuple[int, tuple[int, float]]:
        kind, weight = symbol
        if kind == trigger:
            return reach, symbol
        written = (kind, weight * factor) if state and kind in affected else symbol
        return max(0, state - 1), written

    return Transducer(reach + 1, step)


def _sticky(trigger: int, affected: tuple[int, ...], factor: float) -> Transducer:
    """After ``trigger`` all words of the affected classes have their weight multiplied, to the clause's end."""

    def step(state: int, symbol: tuple[int, float]) -> tuple[int, tuple[int, float]]:
        kind, weight = symbol
        if kind == trigger:
            return 1, symbol
        return state, (kind, weight * factor) if state and kind in affected else symbol

    return Transducer(2, step)


def _threat() -> Transducer:
    """Violence weighs when intended just before, or through the target that follows it."""

    def step(state: int, symbol: tuple[int, float]) -> tuple[int, tuple[int, float]]:
        kind, weight = symbol
        intended, open_for = divmod(state, 4)
        written = (kind, 0.0)
        if kind == INTENDED:
            return 3 * 4, written
        if kind == VIOLENT:
            return 3, (kind, weight if intended else 0.0)
        if kind == TARGET and open_for:
            return 0, (VIOLENT, weight)
        if kind == INSULT:
            written = symbol
        return max(0, intended - 1) * 4 + max(0, open_for - 1), written

    return Transducer(16, step)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds what the first writes to the second."""

    def step(state: int, symbol: tuple[int, float]) -> tuple[int, tuple[int, float]]:
        a, b = divmod(state, second.states)
        a, symbol = first.step(a, symbol)
        b, symbol = second.step(b, symbol)
        return a * second.states + b, symbol

    return Transducer(first.states * second.states, step)


#: The order matters: negation and report discount before the target adds, and the
#: threat machine reads targets last.
GRAMMAR = (
    _window(NEGATION, 3, (INSULT, VIOLENT, TARGET), 0.3),
    _sticky(REPORT, (INSULT, VIOLENT, TARGET), 0.4),
    _window(TARGET, 4, (INSULT,), 1.5),
    _threat(),
)


def machine(parts: tuple[Transducer, ...] = GRAMMAR) -> tuple[list[list[int]], list[list[float]]]:
    """Transition and weight arrays of the composed grammar, over the reachable states."""
    whole = parts[0]
    for part in parts[1:]:
        whole = compose(whole, part)
    number, queue, moves, weights = {0: 0}, [0], [], []
    for state in queue:
        row, gains = [], []
        for kind in range(7):
            following, (_, weight) = whole.step(state, (kind, 1.0))
            if following not in number:
                number[following] = len(number)
                queue.append(following)
            row.append(number[following])
            gains.append(weight)
        moves.append(row)
        weights.append(gains)
    return moves, weights


@dataclass
class Model:
    """What is learned: insult strengths of words and beginnings, and the text weights."""

    words: dict[str, float]
    stems: dict[str, float]
    weights: tuple[float, ...] = (-4.0, 1.2, 0.6, 0.3, 0.3)

    def classify(self, word: str) -> tuple[int, float]:
        """Class and strength of a word: the strongest of its own evidence and its beginnings', else the
        seeds. From the whole word to shorter beginnings, one known as clean ends the search."""
        strength = 0.0
        for known in (self.words.get(word), *(self.stems.get(word[:n]) for n in reversed(STEMS) if n <= len(word))):
            if known == 0.0:
                return SEEDS.get(word, OTHER) if SEEDS.get(word) != INSULT else OTHER, SEED_STRENGTH
            strength = max(strength, known or 0.0)
        return (INSULT, strength) if strength else (SEEDS.get(word, OTHER), SEED_STRENGTH)


class Lexicon(dict):
    """Words classified so far; forgets everything when it grows large."""

    def __init__(self, model: Model, limit: int = 500_000) -> None:
        self.model, self.limit = model, limit

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = self.model.classify(word)
        return found


class Scorer:
    """Clause scores of texts under a model."""

    def __init__(self, model: Model) -> None:
        self.model, self.lexicon = model, Lexicon(model)
        self.moves, self.gains = machine()

    def features(self, text: str | None) -> tuple[float, ...]:
        """Constant, log of the summed scores, largest clause score, log of the matched clauses,
        log of the scores per hundred words."""
        total = largest = 0.0
        matched = words = 0
        lexicon, moves, gains = self.lexicon, self.moves, self.gains
        for clause in _CLAUSE.split((text or "").lower()):
            read = [lexicon[w] for w in _WORD.findall(clause)]
            words += len(read)
            if not any(kind == INSULT or kind == VIOLENT for kind, _ in read):
                continue
            state, score = 0, 0.0
            for kind, strength in read:
                gain = gains[state][kind]
                if gain:
                    score += gain * strength
                state = moves[state][kind]
            if score > 0:
                total += score
                largest = max(largest, score)
                matched += 1
        return 1.0, float(np.log1p(total)), min(largest, 10.0), float(np.log1p(matched)), float(np.log1p(100 * total / max(words, 1)))

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.features(text), self.model.weights))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: tuple[float, ...], ridge: float = 1.0) -> tuple[float, ...]:
    """Weighted ridge logistic regression by Newton steps, drawn to ``start``."""
    w = origin = np.array(start)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * (w - origin)
        change = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w = w - change
        if abs(change).max() < 1e-6:
            break
    return tuple(map(float, w))


def sample(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Texts and labels to learn from: about ``max_labelled`` of each label by hash, none with crc32 mod 3 = 1.

    ``weight`` says how many labelled rows a drawn one stands for. The drawn labels are few by that bound and are broadcast, so documents are not shuffled.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(
        (fold(F.col("id")) != 1) & F.col("toxic").isin(0, 1)
    )
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(max_labelled / max(1, counts.get(1, 0)))).otherwise(
        F.lit(max_labelled / max(1, counts.get(0, 0)))
    )
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30))
    drawn = known.where(draw / float(1 << 30) < share).withColumn("half", F.pmod(draw, F.lit(2)).cast("int"))
    drawn = drawn.withColumn("weight", F.greatest(F.lit(1.0), 1 / share))
    texts = documents.select(documents["doc_id"].alias("id"), documents["text"].cast("string").alias("text")).where("text is not null")
    return texts.join(F.broadcast(drawn), "id").select("text", "toxic", "half", "weight")


def learn_lexicon(counted: pd.DataFrame) -> Model:
    """Insults from term counts ``t`` in toxic and ``c`` in clean texts; the term "" counts the texts.

    The strength of a term is its log ratio less two standard errors. A term is
    known as clean if even the ratio plus two standard errors is weak. A beginning
    counts where at least ``STEM_WORDS`` different telling words have it, which one
    inflected insult has and a single word has not.
    """
    model = Model({}, {})
    whole = counted[counted["term"] == ""]
    toxic, clean = float(whole["t"].sum()), float(whole["c"].sum())
    if not toxic or not clean:
        return model
    t, c = counted["t"] + 0.5, counted["c"] + 0.5
    ratio, error = np.log(t / (toxic + 1)) - np.log(c / (clean + 1)), 2 * np.sqrt(1 / t + 1 / c)
    terms = counted["term"].tolist()
    telling = [w for w, r, e in zip(terms, ratio, error) if w and not w.endswith("*") and r - e >= MIN_EVIDENCE]
    shared = Counter(w[:n] for w in telling for n in STEMS if n <= len(w))
    for term, r, e in zip(terms, ratio, error):
        group, name = (model.stems, term[:-1]) if term.endswith("*") else (model.words, term)
        if term and r + e < MIN_STRENGTH:
            group[name] = 0.0
        elif term and r - e >= MIN_STRENGTH and (group is model.words or shared[name] >= STEM_WORDS):
            group[name] = float(r - e)
    return model


def learn(rows: DataFrame) -> Model:
    """Insult strengths and text weights from a sample, cross-fitted.

    Texts of either half are measured with the insults of the other half to fit the
    text weights; the final insults come from both halves.
    """

    def terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], Counter] = {}
        for frame in frames:
            for text, toxic, half in zip(frame["text"], frame["toxic"], frame["half"]):
                found = set(_WORD.findall(text.lower()))
                stems = {f"{w[:n]}*" for w in found for n in STEMS if len(w) >= n}
                seen.setdefault((toxic, half), Counter()).update(found | stems | {""})
        for (toxic, half), counts in seen.items():
            yield pd.DataFrame({"term": list(counts), "toxic": toxic, "half": half, "n": list(counts.values())})

    def number(toxic: int, *halves: int) -> Column:
        return F.sum(F.when((F.col("toxic") == toxic) & F.col("half").isin(*halves), F.col("n")).otherwise(0))

    columns = {f"{name}{'' if len(h) > 1 else h[0]}": number(y, *h) for name, y in (("t", 1), ("c", 0)) for h in ((0, 1), (0,), (1,))}
    counted = collected(
        rows.mapInPandas(terms, "term string, toxic int, half int, n bigint")
        .groupBy("term")
        .agg(*(c.alias(name) for name, c in columns.items()))
        .where((F.col("t") >= MIN_SUPPORT) | (F.col("term") == ""))
    )
    parts = [
        learn_lexicon(counted[["term", f"t{h}", f"c{h}"]].set_axis(["term", "t", "c"], axis=1).query(f"t >= {MIN_SUPPORT} or term == ''"))
        for h in (0, 1)
    ]

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(m) for m in parts]
        for frame in frames:
            if len(frame):
                x = np.array([scorers[1 - h].features(t) for t, h in zip(frame["text"], frame["half"])])
                yield pd.DataFrame(x, columns=list("abcde")).assign(y=frame["toxic"].to_numpy(), w=frame["weight"].to_numpy())

    model = learn_lexicon(counted)
    measured = collected(rows.mapInPandas(measure, "a double, b double, c double, d double, e double, y int, w double"))
    if measured["y"].nunique() == 2:
        model.weights = logistic(measured[list("abcde")].to_numpy(), measured["y"].to_numpy(dtype=float), measured["w"].to_numpy(), model.weights)
    return model


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, ``score`` (0 to 1) and ``clauses`` that matched.

    Null and empty texts match nothing and get the lowest score; repeated rows are
    scored each; empty tables give no rows; other columns are not read. Texts are
    read whole.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("score double, clauses bigint")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        weights = np.array(scorer.model.weights)
        for texts in batches:
            x = np.array([scorer.features(t) for t in texts]).reshape(-1, 5)
            z = np.clip(x @ weights, -30, 30)
            yield pd.DataFrame({"score": 1 / (1 + np.exp(-z)), "clauses": np.rint(np.expm1(x[:, 3])).astype("int64")})

    found = documents.select(documents[id_col].alias("id"), measure(documents[text_col].cast("string")).alias("found"))
    return found.select(F.col("id").alias(id_col), "found.score", "found.clauses")
