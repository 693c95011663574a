"""Toxicity by a learned lexicon, fuzzy matching and context windows.

* Learning: of about ``TRAIN_TOXIC`` and ``TRAIN_CLEAN`` labelled texts at most (the smallest id hashes of each class; the bound
  concerns this fit alone) words and word beginnings are counted by class. Terms that toxic texts hold far oftener are
  candidates; chosen are, one by one, those that most add to the toxic texts that hold two of them. Chosen terms make a trie.
* Matching: a Levenshtein automaton runs over the trie: its states are sets of (trie node, edits so far), made
  deterministic as words need them. Terms of ``FUZZY_LENGTH`` letters and more may be one edit away, so misspelled terms
  are caught; word beginnings match words that go on.
* Context: each match is scored in a window around it. Inside quotation marks it counts as quoted; other matches near
  by raise it. Sums of exact, misspelled and quoted matches, the terms' variety and the best window are the features of
  a logistic regression, fitted with each class at its full weight.

Scoring is one pass over whole texts without a shuffle. Results by case: a null or empty text has no match and gets the
score that such texts have; without toxic labels to learn from every score is 0; labels that aren't 0 or 1 are left
out, and a document labelled twice is toxic if any label says so; repeated rows are scored alike; a null id isn't held
out; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanlens.llm.common import about, kept, row_slices, small_batches

TRAIN_TOXIC, TRAIN_CLEAN = 2500, 7500
BEGINNINGS, FUZZY_LENGTH, MOST_STATES = (4, 5, 6), 6, 50_000
#: A term's least toxic texts, least ratio of its rates, and the candidates looked at.
SUPPORT, RATIO, CANDIDATES = 3, 30.0, 4000
WINDOW_CHARS, SLICE_BYTES = 60, 1 << 20
_WORD = re.compile(r"[^\W_]+")
_OPEN, _CLOSE = "\"“”„«»‹›‘", "\"“”«»‹›’"


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text, divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class FuzzyTrie:
    """Terms in a trie and the Levenshtein automaton over it. A term ending in ``*`` is a word beginning."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, list[tuple[int, bool, int]]] = defaultdict(list)  # node -> term, beginning, edits allowed
        for i, term in enumerate(terms):
            node, letters = 0, term.rstrip("*")
            for c in letters:
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.children):
                    self.children.append({})
            self.ends[node].append((i, term.endswith("*"), int(len(letters) >= FUZZY_LENGTH)))
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.members: list[tuple] = []
        self.begin: list[tuple[int, int] | None] = []  # best word beginning reached: edits, term
        self.whole: list[tuple[int, int] | None] = []  # best whole word, if the word ends here
        self.start = self.state({0: 0})

    def state(self, edits: dict[int, int]) -> int:
        """The state of these (node, edits), and of what leaving out letters of a term adds."""
        for node, e in list(edits.items()):
            if e == 0:
                for child in self.children[node].values():
                    edits.setdefault(child, 1)
        key = tuple(sorted(edits.items()))
        if key not in self.states:
            self.states[key] = len(self.steps)
            self.steps.append({})
            self.members.append(key)
            found = [(e, i, begins) for node, e in key for i, begins, most in self.ends.get(node, ()) if e <= most]
            self.begin.append(min(((e, i) for e, i, b in found if b), default=None))
            self.whole.append(min(((e, i) for e, i, _ in found), default=None))
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for node, e in self.members[state]:
            moves = [(node, e + 1)] if e == 0 else []  # a letter too many
            for x, child in self.children[node].items():
                if x == c:
                    moves.append((child, e))
                elif e == 0:
                    moves.append((child, 1))  # another letter
            for n, d in moves:
                after[n] = min(d, after.get(n, 9))
        self.steps[state][c] = new = self.state(after)
        return new

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the best match of a word, if any."""
        if len(self.steps) > MOST_STATES:
            self.reset()
        state, best = self.start, None
        for c in word:
            state = self.steps[state].get(c) if c in self.steps[state] else self.step(state, c)
            if (b := self.begin[state]) and (best is None or b < best):
                best = b
            if not self.members[state]:
                return best
        last = self.whole[state]
        return last if last and (best is None or last < best) else best


def _quoted(text: str, start: int, end: int) -> bool:
    """Between quotation marks of one line, both within the window."""
    left = text[max(0, start - WINDOW_CHARS) : start].rpartition("\n")[2]
    right = text[end : end + WINDOW_CHARS].partition("\n")[0]
    before = sum(c in _OPEN for c in left)
    return before % 2 == 1 and any(c in _CLOSE for c in right)


def features(text: str, matched: dict[str, tuple[int, int]]) -> list[float]:
    """Of a lower-cased text whose words in ``matched`` are terms: exact, misspelled and quoted matches, variety, best window."""
    hits = [(m.start(), m.end(), *matched[m[0]]) for m in _WORD.finditer(text) if m[0] in matched]
    exact = fuzzy = quoted = 0
    scored = []
    for start, end, edits, term in hits:
        if _quoted(text, start, end):
            quoted += 1
            scored.append((start, 0.25))
        elif edits:
            fuzzy += 1
            scored.append((start, 0.5))
        else:
            exact += 1
            scored.append((start, 1.0))
    best = at = total = 0
    for start, s in scored:  # the most that one window holds
        total += s
        while scored[at][0] < start - 2 * WINDOW_CHARS:
            total -= scored[at][1]
            at += 1
        best = max(best, total)
    variety = len({h[3] for h in hits if not h[2]})
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), min(variety, 5) / 5, math.log1p(best)]


NO_MATCH = [0.0] * 5


def _matches(texts: list[str | None], trie: FuzzyTrie) -> Iterator[list[float]]:
    """The features of each text. Its words go through the automaton text by text: the automaton's states, bounded in
    number, are all that is remembered, and no table of words grows with the corpus."""
    match = trie.match
    for text in texts:
        lowered = text.lower() if text else ""
        matched = {w: m for w in set(_WORD.findall(lowered)) if (m := match(w))}
        yield features(lowered, matched) if matched else NO_MATCH


def _matcher(terms: list[str]) -> FuzzyTrie:
    return kept(("toxicity", *terms), lambda: FuzzyTrie(terms))


def _terms_of(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for n in BEGINNINGS for w in words if len(w) >= n}


def choose_terms(found: list[list[str]], clean: dict[str, int], least_new: int = SUPPORT) -> list[str]:
    """Terms that give the toxic texts (``found``: candidates in each) two terms each, greedily; clean texts count against."""
    where = defaultdict(set)
    for i, terms in enumerate(found):
        for t in terms:
            where[t].add(i)
    need = [2] * len(found)
    chosen: list[str] = []
    while where:
        gain = {t: sum(need[i] > 0 for i in docs) - 5 * clean.get(t, 0) for t, docs in where.items()}
        best = max(gain, key=lambda t: (gain[t], len(t), t))
        if gain[best] < least_new:
            break
        chosen.append(best)
        for i in where.pop(best):
            need[i] -= 1
        # what a chosen beginning covers adds nothing, nor does a beginning that only this word has
        stem = best.rstrip("*")
        for t in [t for t in where if t.rstrip("*").startswith(stem) or (stem.startswith(t.rstrip("*")) and t.endswith("*"))]:
            if best.endswith("*") or t.rstrip("*") == stem:
                del where[t]
    return chosen


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps; the intercept comes first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, penalty)] * weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray] | None:
    """Terms and weights from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); none without both classes."""
    small_batches(docs.sparkSession)
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    total = {r._toxic: r.n for r in usable.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if not total.get(0) or not total.get(1):
        return None
    sample = about(usable.filter("_toxic = 1"), "doc_id", TRAIN_TOXIC, total[1]).unionByName(about(usable.filter("_toxic = 0"), "doc_id", TRAIN_CLEAN, total[0]))
    train = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # one text an id, however many rows it has, so that the sample's bound holds for what is fitted
    one = F.max_by("text", F.xxhash64("text")).alias("text")
    train = train.groupBy("doc_id").agg(one, F.max("_toxic").cast("int").alias("_toxic")).select("text", "_toxic").checkpoint()
    seen = Counter({r._toxic: r.n for r in train.groupBy("_toxic").agg(F.count("*").alias("n")).collect()})
    if not seen[0] or not seen[1]:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t in _terms_of(text or ""):
                    counts[t][toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], names=["term", "clean", "toxic"])

    counted = train.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = (F.col("toxic") / seen[1]) / ((F.col("clean") + 0.5) / seen[0])
    candidates = counted.filter((F.col("toxic") >= SUPPORT) & (rate >= RATIO)).orderBy(F.desc("toxic"), "term").limit(CANDIDATES).collect()
    clean = {r.term: r.clean for r in candidates}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(_terms_of(t or "") & clean.keys()) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["found"])

    found = [r.found for r in train.filter("_toxic = 1").select("text").mapInArrow(present, "found array<string>").collect()]
    terms = choose_terms(found, clean)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(_matches(batch.column(0).to_pylist(), _matcher(terms))), pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = train.mapInArrow(measure, "toxic int, x array<double>").collect()
    y = np.array([r.toxic for r in rows], float)
    return terms, _fit(np.array([r.x for r in rows]), y, np.where(y == 1, total[1] / seen[1], total[0] / seen[0]))


def toxicity(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``; learned from its own labelled rows, or from others."""
    learned = learn(docs if learn_from is None else learn_from, labels)
    names = docs.select("doc_id", "text")
    if learned is None:
        return names.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    scores = _scorer(*learned)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores(rows.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = names.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _scorer(terms: list[str], w: np.ndarray):
    def scores(texts: list[str | None]) -> np.ndarray:
        x = np.array(list(_matches(texts, _matcher(terms)))).reshape(-1, len(NO_MATCH))
        return 1 / (1 + np.exp(-(w[0] + x @ w[1:])))

    return scores


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't predicted toxic."""
    learned = learn(docs, labels)
    if learned is None:
        return docs
    scores = _scorer(*learned)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "text", SLICE_BYTES):
                yield rows.filter(pa.array(scores(rows.column("text").to_pylist()) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
