"""Toxicity by fuzzy lexicon search and context windows.

The lexicon is learnt from labelled documents: words, and beginnings of words, that toxic
documents hold far more often than others, weighted by the logarithm of how much. Its terms
form a trie. The Levenshtein automata of all
terms are run over it at once: a state is the set of trie nodes that the letters read so far
can stand at, with the edits spent, and states are made when they are first met. So a word is
looked up in a few steps, and misspelt terms are found with the edits they need.

Each hit is weighed in its window of words: less where it stands in quotation marks or beside
a verb of reporting (quotation), more where other hits stand near (abuse). The sum for a
document, on a logarithmic scale, is turned into a probability by a calibration on the same
labelled documents.

* Labels are learnt only from documents that are not held out, at most ``LABELLED`` rows of
  each label (expected number; those with the smallest hashes of their id). Misspellings that
  such documents without toxicity hold count as ordinary words. Scores read whole texts.
* The lexicon has at most ``TERMS`` terms, those with the highest weights, taken from the 20 times as
  many that most toxic documents of the sample hold: a bound of the model, not of what is scored.
* A null or empty text, and a text without hits, gets the score of no hits. Where there are no
  toxic labels to learn from, that score is 0. Rows of ``labels`` with a null are left out.
* Repeated rows are repeated; an empty table gives no rows. Of ``docs`` only doc_id and text
  are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import flat, held_out, texts_of, written

LABELLED = 5000
#: Letters of beginnings; share of the toxic documents that a term needs (and how many at least: copies of a few repeat
#: all their words); logarithm of how much more often toxic documents hold it; terms kept.
STEMS, COMMON, LEAST, ODDS, TERMS = range(4, 9), 0.02, 4, 2.0, 1000
#: States of the automata that a worker keeps before it makes them anew.
STATES = 50_000
#: Letters from which a word may be one, or two, edits away from a term. Beginnings must match exactly.
ONE_EDIT, TWO_EDITS = 5, 9
WINDOW, QUOTED, FUZZY, NEAR, REPEATED = 12, 0.3, 0.7, 1.25, 0.2
LIMIT = 0.3
BLOCK_BYTES = 8 << 20

PIECE = re.compile(r"[^\W_]+")
QUOTES = "\"“”„«»‘’‹›"
#: Verbs of reporting, in English, German, French and Spanish.
REPORTING = frozenset("said says wrote writes called calls quoted quotes sagte sagt schrieb nannte dit écrit appelle dijo dice escribió llamó".split())


class Trie:
    """Weighted terms; one that ends with * stands for every word that begins so."""

    def __init__(self, terms: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.words: dict[int, tuple[float, int]] = {}  # node: weight of the word that ends here, edits it allows
        self.beginnings: dict[int, float] = {}
        self.most = [0]  # edits that some word below allows
        for term, weight in terms.items():
            word = term.rstrip("*")
            edits = 0 if term != word or len(word) < ONE_EDIT else 1 if len(word) < TWO_EDITS else 2
            node = 0
            self.most[0] = max(self.most[0], edits)
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits)
            if term != word:
                self.beginnings[node] = weight
            else:
                self.words[node] = (weight, edits)


class Matcher:
    """The Levenshtein automata of a trie's terms, as one automaton whose states are made on demand.

    A position is (node, edits, awaited): ``awaited`` is the letter that completes a swap of
    two neighbours, or empty. Position -1 - node follows a beginning that has matched: any
    letter may come.
    """

    def __init__(self, trie: Trie):
        self.trie = trie
        self.clear()

    def clear(self) -> None:
        """Forgets all states but the first; they are made anew when they are met."""
        self.sets: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[float, float]] = []  # weight of what ends here without edits, and with them
        self.start = self.number(self.closed({(0, 0, "")}))

    def closed(self, positions: set) -> frozenset:
        """With what is reached by letters that the word lacks, and by matched beginnings; no position that costs more than another."""
        best: dict[tuple, int] = {}
        left = list(positions)
        while left:
            node, spent, awaited = left.pop()
            if best.get((node, awaited), 99) <= spent or (node >= 0 and spent > self.trie.most[node]):
                continue
            best[(node, awaited)] = spent
            if node < 0 or awaited:
                continue
            if node in self.trie.beginnings and spent == 0:
                left.append((-1 - node, 0, ""))
            left += [(child, spent + 1, "") for child in self.trie.children[node].values()]
        return frozenset((n, s, a) for (n, a), s in best.items())

    def number(self, positions: frozenset) -> int:
        if positions not in self.numbers:
            self.numbers[positions] = len(self.sets)
            self.sets.append(positions)
            self.steps.append({})
            exact, edited = 0.0, 0.0
            for node, spent, awaited in positions:
                if node < 0:
                    exact = max(exact, self.trie.beginnings[-1 - node])
                elif not awaited and node in self.trie.words and spent <= self.trie.words[node][1]:
                    weight = self.trie.words[node][0]
                    exact, edited = (max(exact, weight), edited) if spent == 0 else (exact, max(edited, weight * FUZZY**spent))
            self.accepts.append((exact, edited))
        return self.numbers[positions]

    def after(self, state: int, letter: str) -> int:
        """The state after ``letter``, or -1 where no term is left."""
        out = set()
        for node, spent, awaited in self.sets[state]:
            if node < 0:
                out.add((node, spent, ""))
                continue
            if awaited:
                # node is where the swapped pair ends
                if letter == awaited:
                    out.add((node, spent, ""))
                continue
            children = self.trie.children[node]
            if letter in children:
                out.add((children[letter], spent, ""))
            out.add((node, spent + 1, ""))
            for c, child in children.items():
                if c != letter:
                    out.add((child, spent + 1, ""))
                    if letter in self.trie.children[child]:
                        out.add((self.trie.children[child][letter], spent + 1, c))
        found = self.closed(out)
        return self.number(found) if found else -1

    def weights(self, word: str) -> tuple[float, float]:
        """Weights of the heaviest terms that ``word`` is, and that it is near."""
        if len(self.sets) > STATES:
            self.clear()
        state = self.start
        for letter in word:
            known = self.steps[state]
            if letter not in known:
                known[letter] = self.after(state, letter)
            state = known[letter]
            if state < 0:
                return 0.0, 0.0
        return self.accepts[state]


def pieces(token: str) -> list[str]:
    return PIECE.findall(token.lower())


class Scorer:
    def __init__(self, terms: dict[str, float], ordinary: set[str], slope: float, intercept: float):
        self.terms, self.ordinary, self.slope, self.intercept = terms, ordinary, slope, intercept
        self.ready()

    def ready(self) -> None:
        self.matcher = Matcher(Trie(self.terms))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "matcher"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ready()

    def token_weight(self, token: str) -> float:
        """The weight of the term that a token is, or is near to; 0 for other words."""
        best = 0.0
        for piece in pieces(token):
            exact, edited = self.matcher.weights(piece)
            best = max(best, exact, 0.0 if piece in self.ordinary else edited)
        return best

    def severity(self, tokens: list[str], hits: list[tuple[int, float]]) -> float:
        """Sum of the weights of ``hits`` (place, weight), each weighed in its window."""
        total, places, seen = 0.0, [p for p, _ in hits], set()
        for k, (place, weight) in enumerate(hits):
            low, high = max(0, place - WINDOW), min(len(tokens), place + WINDOW + 1)
            before, after = "".join(tokens[low:place]) + tokens[place][:1], tokens[place][-1:] + "".join(tokens[place + 1 : high])
            quoted = sum(before.count(q) for q in QUOTES) % 2 == 1 and any(q in after + tokens[place] for q in QUOTES)
            told = any(p in REPORTING for t in tokens[max(low, place - 4) : min(high, place + 5)] for p in pieces(t))
            near = (k > 0 and place - places[k - 1] <= WINDOW) or (k + 1 < len(places) and places[k + 1] - place <= WINDOW)
            total += weight * (QUOTED if quoted or told else NEAR if near else 1.0) * (REPEATED if tokens[place] in seen else 1.0)
            seen.add(tokens[place])
        return total

    def severities(self, texts: pa.Array) -> Iterator[float]:
        """One for each text: what its words' hits add up to. Distinct words are looked up once for each block of texts."""
        _, ends = flat(texts)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_BYTES, "right")) - 1)
            own = texts.slice(at, to - at).fill_null("")
            cut = pc.split_pattern(pc.replace_substring(own, "\n", " "), " ")
            places = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
            coded = cut.flatten().dictionary_encode()
            weights = np.array([self.token_weight(t) for t in coded.dictionary.to_pylist()] or [0.0])[coded.indices.to_numpy(zero_copy_only=False)]
            struck = np.flatnonzero(weights)
            row = np.searchsorted(places, struck, "right") - 1
            by_row = np.split(struck, np.searchsorted(row, np.arange(1, to - at)))
            for k, hits in enumerate(by_row):
                if len(hits):
                    tokens = cut[k].as_py()
                    yield self.severity(tokens, [(int(h - places[k]), float(weights[h])) for h in hits])
                else:
                    yield 0.0
            at = to

    def score(self, severity: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(severity) + self.intercept))))


def candidates_of(text: str) -> set[str]:
    words = set(pieces(text))
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


def counted(sample: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """(term, toxic, n): documents of the sample that hold a term, by label; each task adds up its own first."""
    shared = sample.sparkSession.sparkContext.broadcast(wanted)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, toxic in zip(texts_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                found = candidates_of(text.decode("utf-8", "replace"))
                counts[toxic].update(found if shared.value is None else found & shared.value)
        rows = [(t, y, n) for y in (0, 1) for t, n in counts[y].items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["term", "toxic", "n"])

    return sample.select("text", "toxic").mapInArrow(of, "term string, toxic int, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n"))


def lexicon(sample: DataFrame, clean: int, toxic: int) -> dict[str, float]:
    """Terms with weights up to 1. A beginning is left out where a word, or a longer one, is in as many toxic documents, and what begins so where it tells little more."""
    seen = counted(sample.where("toxic = 1")).where(F.col("n") >= max(LEAST, math.ceil(COMMON * toxic))).orderBy(F.desc("n"), "term").limit(20 * TERMS).collect()
    in_toxic = {r["term"]: r["n"] for r in seen}
    in_clean = {r["term"]: r["n"] for r in counted(sample.where("toxic = 0"), set(in_toxic)).collect()}
    odds = {t: math.log((n / toxic) / ((in_clean.get(t, 0) + 0.5) / (clean + 1))) for t, n in in_toxic.items()}
    kept: dict[str, float] = {}
    for term in sorted((t for t in odds if odds[t] >= ODDS), key=lambda t: (-in_toxic[t] * odds[t], t.endswith("*"), -len(t), t)):
        word = term.rstrip("*")
        above = [odds[f"{word[:k]}*"] for k in STEMS if k <= len(word) and f"{word[:k]}*" in kept]
        below = [k for k in kept if term != word and k.startswith(word) and in_toxic[k] >= 0.95 * in_toxic[term]]
        if not below and not any(o >= odds[term] - 1 for o in above):
            kept[term] = odds[term]
    most = max(kept.values(), default=1.0)
    return {t: o / most for t, o in list(kept.items())[:TERMS]}


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Scorer:
    own = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return Scorer({}, set(), 0.0, -30.0)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(2**31))
    below = lambda y: int(min(1.0, labelled / counts[y]) * 2**31)
    # bounded by the parameter, so it may go to every task
    chosen = own.where(drawn < F.when(F.col("toxic") == 1, below(1)).otherwise(below(0))).dropDuplicates(["doc_id"])
    sample = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").join(F.broadcast(chosen), "doc_id"), "labelled")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Scorer({}, set(), 0.0, -30.0)
    terms = lexicon(sample, sizes[0], sizes[1])
    shared = sample.sparkSession.sparkContext.broadcast(Scorer(terms, set(), 1.0, 0.0))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for b in batches:
            for text in texts_of(b.column(0)):
                found |= {p for p in set(pieces(text.decode("utf-8", "replace"))) if shared.value.matcher.weights(p)[1] > 0}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    ordinary = {r["word"] for r in sample.where("toxic = 0").select("text").mapInArrow(neighbours, "word string").distinct().collect()}
    scorer = Scorer(terms, ordinary, 1.0, 0.0)
    again = sample.sparkSession.sparkContext.broadcast(scorer)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(again.value.severities(b.column(0))), pa.float64()), b.column(1)], ["severity", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(summed, "severity double, toxic int").collect()
    scorer.slope, scorer.intercept = calibrated(np.array([r["severity"] for r in rows]), np.array([r["toxic"] for r in rows]))
    return scorer


def calibrated(severity: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Platt's slope and intercept on the logarithm of severities, with his smoothed targets, by Newton steps."""
    x, n1, n0 = np.log1p(severity), toxic.sum(), (1 - toxic).sum()
    target = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, design.T @ (p - target) + 1e-3 * w), -2, 2)
    return max(0.0, float(w[0])), float(w[1])


def predict(docs: DataFrame, scorer: Scorer, limit: float = LIMIT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [shared.value.score(s) for s in shared.value.severities(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    out = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= limit).cast("int"))
