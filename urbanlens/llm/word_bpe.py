"""Encoding and decoding by a public word-level BPE vocabulary with word ends.

Frequent words of the corpus are compiled, with their ids, into a minimal acyclic transducer: states that accept the
same endings are shared, and each arc carries the number of words that sort before those behind it, so the sum along
a word's path is its place in the table of ids (:class:`Lexicon`). It is one flat file, bounded by ``LEXICON_WORDS``,
that Spark hands to every executor; the executor's workers map it into memory, read-only, and so share it. A word that
the lexicon lacks is merged exactly, pair by pair in rank order (:class:`Merger`). Words are counted over all documents;
counts decide speed only, never ids. Texts with characters that this Python's tables don't know, being newer, are
normalized and split by the library's own normalizer and pre-tokenizer, whose tables decide.

Results by case: a null or empty text, or one of white space only, has no ids and decodes to an empty text; special
strings inside texts become their ids, as the library does; very long texts and words are encoded whole (the merging of
one word takes n log n steps); repeated rows and null ids give a row each; an empty table gives no rows; columns other
than the id and the text are ignored.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import sys
import unicodedata
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanlens.llm.common import SPACE, Remembered, kept, row_slices, small_batches, written
from urbanlens.llm.pieces import byte_characters, load_tokenizer
from urbanlens.session import fresh_dir

LEXICON_WORDS, REMEMBERED = 50_000, 70_000
SLICE_BYTES, COUNTED_WORDS, WORD_CHARS = 1 << 19, 200_000, 64
#: Symbols up to which a word is merged by plain search; above every rank.
SHORT, NONE = 40, 1 << 60
#: Fixed value, the vocabulary's own pattern for words; white space is spelled out as its library reads it.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
#: The same for texts of characters up to U+00FF, which Python's faster ``re`` can express.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{SPACE}{_L}{_N}]+")
_ANY = regex.compile(WORDS)


class Vocabulary:
    """What the tokenizer's file says: ids by symbol, ranks of pairs, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.ids: dict[str, int] = told["model"]["vocab"]
        self.ranks = {tuple(p.split(" ") if isinstance(p, str) else p): i for i, p in enumerate(told["model"]["merges"])}
        self.end = told["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.symbols = {i: s for s, i in (self.ids | self.special).items()}
        self.characters = byte_characters()

    def decode(self, ids: Iterable[int]) -> str:
        """The symbols of the ids with blanks between: the file names no decoder."""
        return " ".join(filter(None, map(self.symbols.get, ids)))


@cache
def _unknown() -> re.Pattern:
    """Characters that Python's tables don't assign."""
    codes = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])
    first, last = (np.flatnonzero(codes & ~np.roll(codes, s)) for s in (1, -1))
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(first, last, strict=True)) + "]")


class Words:
    """The words of a text, special strings among them, as the vocabulary's normalizer and pattern find them."""

    def __init__(self, special: Iterable[str], path: str):
        self.special, self.path, self.library = set(special), path, None
        self.bytes = {c: b for b, c in byte_characters().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]

    def __call__(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return self.plain(text)
        return [w for part in self.split(text) for w in ([part] if part in self.special else self.plain(part))]

    def by_library(self, text: str) -> list[str]:
        """The same words from the library's own steps."""
        self.library = self.library or load_tokenizer(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes[c] for c in w).decode() for w, _ in found]

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            if text and max(text) > "\u024f" and _unknown().search(text):
                return self.by_library(text)
            text = unicodedata.normalize("NFC", text)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # letter by letter: no final sigma
        try:
            text.encode("latin-1")
            return _LATIN.findall(text)
        except UnicodeEncodeError:
            return _ANY.findall(text)


class Merger:
    """Exact byte-pair merging of single words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def __call__(self, word: str) -> list[int]:
        v = self.v
        symbols: list[str | None] = list(word.encode().decode("latin-1").translate(v.characters))
        if not symbols:
            return []
        symbols[-1] += v.end
        if len(symbols) <= SHORT:
            return self.short(symbols)
        n, after, before = len(symbols), [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := v.ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j], after[i] = a + b, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := v.ranks.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return [v.ids[s] for s in symbols if s is not None and s in v.ids]


    def short(self, symbols: list[str]) -> list[int]:
        """The same for few symbols: the leftmost pair of lowest rank, until none is left."""
        ranks, ids = self.v.ranks, self.v.ids
        found = [ranks.get(p, NONE) for p in pairwise(symbols)]
        while found and (low := min(found)) != NONE:
            i = found.index(low)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del found[i]
            if i:
                found[i - 1] = ranks.get((symbols[i - 1], symbols[i]), NONE)
            if i < len(found):
                found[i] = ranks.get((symbols[i], symbols[i + 1]), NONE)
        return [ids[s] for s in symbols if s in ids]


class Lexicon:
    """Words with ids as a minimal acyclic transducer in one byte string (little-endian 32-bit integers)."""

    def __init__(self, data):
        a = memoryview(data).cast("i")
        sizes, at = a[:5], 5
        self.first, self.label, self.target, self.skip, self.span, self.ids = (a[at + s : at + e] for s, e in self._parts(sizes))

    @staticmethod
    def _parts(sizes):
        states, arcs, words, ids, _ = map(int, sizes)
        at = 0
        for n in (states + 1, arcs, arcs, arcs, words + 1, ids):
            yield at, at + n
            at += n

    @classmethod
    def compile(cls, entries: dict[str, list[int]]) -> bytes:
        """Added in order of bytes, so that whatever is behind the last common prefix is final and can be shared."""
        words = sorted((w.encode(), ids) for w, ids in entries.items())
        shared: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((label, state), ...)), numbered as they are shared
        path: list[list] = [[False, []]]  # open states along the last word: final, arcs so far

        def close(depth: int, last: bytes) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in shared:
                    shared[key] = len(states)
                    states.append(key)
                path[-1][1].append((last[len(path) - 1], shared[key]))

        last = b""
        for w, _ in words:
            same = next((i for i, (x, y) in enumerate(zip(w, last, strict=False)) if x != y), min(len(w), len(last)))
            close(same, last)
            path += [[False, []] for _ in w[same:]]
            path[-1][0] = True
            last = w
        close(0, last)
        states.append((path[0][0], tuple(path[0][1])))  # the root is the last
        behind: list[int] = []  # words from a state on; targets come before their sources
        first, label, target, skip = [0], [], [], []
        for final, arcs in states:
            n = int(final)
            for c, s in arcs:
                label.append(c)
                target.append(s)
                skip.append(n)
                n += behind[s]
            behind.append(n)
            first.append(len(label))
        # a final state's own word sorts first: the sum along a path is the word's place
        final_mark = [(-1 if f else 0) for f, _ in states]
        spans, flat = [0], []
        for _, ids in words:
            flat += ids
            spans.append(len(flat))
        first = [x * 2 + (m < 0) for x, m in zip(first[:-1], final_mark, strict=True)] + [first[-1] * 2]
        return np.array([len(states), len(label), len(words), len(flat), 0, *first, *label, *target, *skip, *spans, *flat], "<i4").tobytes()

    def get(self, word: str) -> list[int] | None:
        """The word's ids, or none if it isn't there."""
        first, label, target, skip, state, place = self.first, self.label, self.target, self.skip, len(self.first) - 2, 0
        for c in word.encode():
            lo, hi = first[state] >> 1, first[state + 1] >> 1
            arc = bisect_left(label, c, lo, hi)
            if arc == hi or label[arc] != c:
                return None
            place += skip[arc]
            state = target[arc]
        if not first[state] & 1:
            return None
        return self.ids[self.span[place] : self.span[place + 1]].tolist()


def frequent_words(docs: DataFrame, tokenizer_path: str, most: int = LEXICON_WORDS) -> list[str]:
    """The commonest words over all texts, ``most`` at most: those above a count. Tasks sum before they hand on."""
    special = list(Vocabulary(tokenizer_path).special)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(special, tokenizer_path), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for slice_ in row_slices(batch, "text", SLICE_BYTES):
                for text in slice_.column("text").to_pylist():
                    counts.update(words(text) if text else ())
                if len(counts) >= COUNTED_WORDS:
                    yield rows()
                    counts = Counter()
        yield rows()

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") > 1) & (F.length("word") <= WORD_CHARS))
    # which counts are in: by classes of counts, an eighth of a doubling each, as many rows as there are classes
    counted = written(counted.withColumn("size", F.floor(F.log2("n") * 8).cast("int")), "word-counts")
    total, least = 0, 0
    for r in counted.groupBy("size").agg(F.count("*").alias("words")).orderBy(F.desc("size")).collect():
        total += r.words
        if total > most:
            least = r.size + 1
            break
    return sorted(r.word for r in counted.filter(F.col("size") >= least).select("word").collect())


def build_lexicon(words: Iterable[str], tokenizer_path: str) -> bytes:
    v = Vocabulary(tokenizer_path)
    merge = Merger(v)
    return Lexicon.compile({w: merge(w) for w in words if w not in v.special})


class Encoder:
    """A worker's encoder: the mapped lexicon file, the exact merger, and the ids that they gave of late. Of a word its ids
    alone are remembered, in one byte string: an executor has several workers, and each remembers for itself."""

    def __init__(self, tokenizer_path: str, lexicon: str):
        self.vocabulary = Vocabulary(tokenizer_path)
        self.words, merge = Words(self.vocabulary.special, tokenizer_path), Merger(self.vocabulary)
        with open(lexicon, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)  # stays when the file is closed
        known = Lexicon(self.map)

        def compute(words: list[str]) -> list[bytes]:
            special = self.vocabulary.special
            found = ([special[w]] if w in special else ids if (ids := known.get(w)) is not None else merge(w) for w in words)
            return [array("I", ids).tobytes() for ids in found]

        self.known = Remembered(compute, REMEMBERED)

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Of each text the ids as little-endian unsigned 32-bit integers, and the decoded text."""
        split = [self.words(t) if t else [] for t in texts]
        for found in self.known.of_groups(split):
            ids = b"".join(found)
            yield ids, self.vocabulary.decode(array("I", ids))


def shipped(spark: SparkSession, data: bytes, name: str) -> str:
    """The name by which tasks find ``data`` as a file (``SparkFiles.get``): it is written to the shared folder, and Spark
    fetches it once for each executor."""
    path = fresh_dir(spark, name)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(conf).create(at, False)
    try:
        for start in range(0, len(data), 1 << 20):
            out.write(bytearray(data[start : start + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def word_bpe(docs: DataFrame, tokenizer_path: str, outputs: dict, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``doc_id`` and one column for each of ``outputs``: name -> (SQL type, function of the ids' bytes and the decoded text)."""
    spark = docs.sparkSession
    small_batches(spark)
    lexicon = shipped(spark, build_lexicon(frequent_words(docs, tokenizer_path, lexicon_words), tokenizer_path), "lexicon")
    makers = [f for _, f in outputs.values()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("word_bpe", tokenizer_path, lexicon), lambda: Encoder(tokenizer_path, SparkFiles.get(lexicon)))
        for batch in batches:
            for rows in row_slices(batch, "text", SLICE_BYTES):
                made = [[f(*found) for f in makers] for found in encoder(rows.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c) for c in zip(*made, strict=True))], names=["doc_id", *outputs])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{name} {sql}" for name, (sql, _) in outputs.items())])
    return docs.select("doc_id", "text").mapInArrow(encode, schema)
