"""Texts operators against brute force on odd rows and on empty tables."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from tokenizers import Tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BLANK = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_token_counts(odd_docs, no_docs):
    from urbanlens.llm.token_counts import token_counts

    t = Tokenizer.from_file(BYTE)
    want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x in rows_of(odd_docs))
    assert Counter(map(tuple, token_counts(odd_docs, BYTE, slice_bytes=500).collect())) == want
    assert token_counts(no_docs, BYTE).count() == 0


def test_pieces_join_to_the_whole_text():
    import random

    from urbanlens.llm.pieces import coder, pieces, segments

    t, rnd = Tokenizer.from_file(BYTE), random.Random(1)
    known = coder(BYTE, "test", list)
    parts = [*"ab é.,;:!?'s  \n\t\x85\xa0 <|>1²\x1cſ", "<|endoftext|>", "'ll", "日本", "word", "\nWord"]
    for _ in range(3000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        found = [p for g in segments(s, 5) for p in pieces(g)]
        assert "".join(found) == s
        assert [x for ids in next(known.of_groups([found])) for x in ids] == t.encode(s, add_special_tokens=False).ids


def test_token_files(spark, odd_docs, no_docs):
    from urbanlens.llm.common import fresh_dir
    from urbanlens.llm.token_files import read_document, read_token_files, write_token_files

    t = Tokenizer.from_file(BYTE)
    path = fresh_dir(spark, "test-files")
    write_token_files(odd_docs, path, BYTE)
    ids = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]
    got = sorted(map(tuple, read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert Counter((i, tuple(x)) for i, _, x in got) == Counter((i, tuple(ids(x))) for i, x in rows_of(odd_docs))
    at = 0
    for _, start, x in got:  # starts are exact, null ids come first, then ascending ids
        assert start == at
        at += len(x)
    order = [-1 if i is None else i for i, _, _ in got]
    assert order == sorted(order)
    digests = {(r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, path, digests=True).collect()}
    assert digests == {(s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for _, s, x in got}
    assert [r.ids for r in read_document(spark, path, 43).collect()] == [ids("one two")]
    empty = fresh_dir(spark, "test-files")
    write_token_files(no_docs, empty, BYTE)
    assert read_token_files(spark, empty).count() == 0


def test_token_files_refuse_another_dictionary(spark, odd_docs):
    from urbanlens.llm.common import fresh_dir
    from urbanlens.llm.token_files import read_token_files, write_token_files

    path = fresh_dir(spark, "test-files")
    write_token_files(odd_docs, path, BYTE)
    spark.createDataFrame([("0" * 64, bytearray(b"x"))], "dict_hash string, dictionary binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="dictionary"):
        read_token_files(spark, path).collect()


def test_word_bpe(odd_docs, no_docs):
    from urbanlens.llm.word_bpe import word_bpe

    t = Tokenizer.from_file(WORD)
    outputs = {"ids": ("binary", lambda ids, _: ids), "decoded": ("string", lambda _, text: text)}
    for most in (50_000, 3):  # most words in the lexicon, or hardly any
        got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in word_bpe(odd_docs, WORD, outputs, most).collect())
        want = Counter()
        for i, x in rows_of(odd_docs):
            ids = t.encode(x or "", add_special_tokens=False).ids
            want[i, np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)] += 1
        assert got == want
    assert word_bpe(no_docs, WORD, outputs).count() == 0


def test_lexicon_is_exact_and_shares_endings():
    from urbanlens.llm.word_bpe import Lexicon

    entries = {w: [i, i + 1] for i, w in enumerate(["ing", "sing", "ring", "sting", "stings", "é", "a", "ab"])}
    lexicon = Lexicon(Lexicon.compile(entries))
    assert all(lexicon.get(w) == ids for w, ids in entries.items())
    assert lexicon.get("in") is None and lexicon.get("abc") is None and lexicon.get("") is None
    assert len(lexicon.first) - 1 < 1 + sum(map(len, entries))
    assert Lexicon(Lexicon.compile({})).get("a") is None


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup(odd_docs, no_docs, keep_first):
    from urbanlens.llm.line_dedup import drop_repeated_lines, line_digests

    rows = rows_of(odd_docs)
    holders, first = defaultdict(set), {}
    key = lambda line: line.strip(BLANK).translate(LOW)
    for i, x in rows:
        for p, line in enumerate((x or "").split("\n")):
            holders[key(line)].add(i)
            first[key(line)] = min(first.get(key(line), (9e9, 0)), (-1 if i is None else i, p))
    for least in (2, 10):
        drop = lambda p, line, least=least: bool(key(line)) and len(holders[key(line)]) >= least

        def kept(i, x, drop=drop):
            if x is None:
                return None
            return "\n".join(line for p, line in enumerate(x.split("\n")) if not (drop(p, line) and not (keep_first and first[key(line)] == (-1 if i is None else i, p))))

        out = drop_repeated_lines(odd_docs, least, keep_first)
        assert out.columns == odd_docs.columns
        if keep_first:  # of the rows of one id the first in order keeps the line; without them the rule is plain
            assert Counter(r for r in rows_of(out) if r[0] != 6) == Counter((i, kept(i, x)) for i, x in rows if i != 6)
            continue
        assert Counter(rows_of(out)) == Counter((i, kept(i, x)) for i, x in rows)
        dropped = lambda i, x: sum(drop(p, line) for p, line in enumerate((x or "").split("\n")))
        want = Counter((i, (x or "").count("\n") + 1, dropped(i, x), sha256((kept(i, x) or "").encode()).hexdigest()) for i, x in rows)
        assert Counter(map(tuple, line_digests(odd_docs, least).collect())) == want
    assert drop_repeated_lines(no_docs).count() == 0 and line_digests(no_docs).count() == 0


def test_streamed_lines_over_many_partitions(spark):
    """A line of a third of all rows lies in several partitions; counts at the edges add up."""
    from urbanlens.llm.line_dedup import repeated_lines

    rows = [(i, f"own {i}\n" + ("hot line\n" if i % 3 == 0 else "") + f"pair {i // 2}\nnine {i // 9}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = defaultdict(set)
    for i, x in rows:
        for p, line in enumerate(x.split("\n")):
            lines[line].add((i, p))
    for least in (2, 9, 10, 300, 301):
        got = {(r.doc_id, r.position) for r in repeated_lines(docs, least).collect()}
        assert got == {x for found in lines.values() if len({i for i, _ in found}) >= least for x in found}


def test_near_duplicates(odd_docs, no_docs):
    from urbanlens.llm.near_dedup import near_duplicates

    rows = rows_of(odd_docs)
    for words, percent, chunk in ((3, 85, 256), (5, 80, 2)):
        sets = {}
        for i, x in rows:
            w = (x or "").encode().lower().split()
            sets[i] = {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set()
        ids = sorted(i for i in sets if i is not None)
        up = {i: i for i in ids}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a in ids:
            for b in ids:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
        got = [tuple(r) for r in near_duplicates(odd_docs, words, percent, chunk).collect()]
        want = [(i, len(sets[i]) if i is not None else None, root(i) if i is not None else None, i is None or root(i) == i) for i, _ in rows]
        assert Counter((i, n if i is not None else None, c, k) for i, n, c, k in got) == Counter(want)
    assert near_duplicates(no_docs).count() == 0


def test_large_groups_in_chunks(spark):
    """A chain of near copies of which neighbours alone are similar, split into small chunks, is one component."""
    from urbanlens.llm.near_dedup import near_duplicates

    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([f"v{j}" for j in range(3 * i)] + base[3 * i :])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs, 3, 85, chunk=4).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_components(spark):
    from urbanlens.llm.components import components

    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 9), (6, 6)], "a long, b long")
    assert {(r.node, r.component) for r in components(links).collect()} == {(5, 2), (4, 2), (3, 2), (2, 2), (9, 7), (8, 7), (7, 7)}


def test_fingerprints(odd_docs, no_docs):
    from urbanlens.llm.fingerprints import edited_neighbours, fingerprints

    rows = rows_of(odd_docs)
    got = edited_neighbours(odd_docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for k, (i, x) in enumerate(order):
        x, after = x or "", order[(k + 1) % len(order)][1] or ""
        third = len(x) // 3
        want[i, len(x), sha256((x[: len(x) - third] + after[:third]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].fingerprint == by_id[6].fingerprint and by_id[2].fingerprint == ""
    assert by_id[1].near_edited == 1.0  # two empty texts
    assert edited_neighbours(no_docs).count() == 0 and fingerprints(no_docs).count() == 0


def units_of(text):
    unspaced = regex.compile(r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u2FDF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\U00020000-\U0003FFFF]")
    out = []
    for run in regex.findall(r"[^\x20\x09-\x0D]+", text):
        for part in regex.findall(rf"{unspaced.pattern}|(?:(?!{unspaced.pattern}).)+", run, regex.DOTALL):
            out += [part] if len(part) <= 16 else list(part)
    return out


def winnowed(text, k, window):
    """Selected (hash, position) pairs: of every window the rightmost least hash."""
    of = lambda x, seed: xxhash.xxh64_intdigest(x, seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    both = lambda x, y: of((y % (1 << 64)).to_bytes(8, "little"), of((x % (1 << 64)).to_bytes(8, "little"), 42))
    h = [of(u.encode(), 42) for u in units_of(text)]
    by = 1
    while by < k:
        h = [both(x, h[i + by]) if i + by < len(h) else x for i, x in enumerate(h)]
        by *= 2
    h = [signed(x) for x in (h[: len(h) - k + 1] if len(h) >= k else h[:1])]
    found = []
    for at in range(max(len(h) - window + 1, min(len(h), 1))):
        part = h[at : at + window]
        p = at + max(i for i, x in enumerate(part) if x == min(part))
        if (h[p], p) not in found:
            found.append((h[p], p))
    return found


def test_winnowing_by_brute_force(spark):
    """All columns, on texts with many equal hashes, long runs and scripts without spaces."""
    from urbanlens.llm.fingerprints import K, WINDOW, edited_neighbours, fingerprints

    rnd = random.Random(6)
    texts = [" ".join(f"u{(i * i) % 23}" for i in range(n)) for n in (0, 1, 3, 4, 5, 18, 19, 20, 60, 200)]
    texts += [" ".join(rnd.choice("ab") for _ in range(120)), "a " * 90, "x" * 15 + " " + "y" * 16 + " " + "z" * 17, "日本語のテキストabcdefghijklmnopqrstuv。" * 9, "ข้อความภาษาไทย" * 7 + " mixed คำ words", "é" * 40 + "\x85\xa0b", "a\tb\nc\rd\x0be"]
    texts += ["".join(rnd.choice("ab \n日本é") for _ in range(400)) for _ in range(12)]
    rows = list(enumerate(texts)) + [(90, None), (91, texts[9]), (91, texts[9]), (None, texts[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, window in ((K, WINDOW), (2, 4)):
        got = Counter((r.doc_id, tuple(map(tuple, r.fingerprint))) for r in fingerprints(docs, k, window).collect())
        assert got == Counter((i, tuple(winnowed(t or "", k, window))) for i, t in rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    show = lambda f: ",".join(f"{h % (1 << 64):016X}@{p}" for h, p in f)

    def like(a, b):
        a, b = ({h for h, _ in f} for f in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    want = Counter()
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        own, changed, following = (winnowed(x, K, WINDOW) for x in (t, edited, after))
        want[i, show(own), show(changed), round(like(own, changed), 12), round(like(own, following), 12)] += 1
    assert Counter((r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in edited_neighbours(docs).collect()) == want


def test_shared_passages_match_at_any_offset(spark):
    """The match guarantee, in a script without spaces and inside long runs too."""
    from urbanlens.llm.fingerprints import K, WINDOW, fingerprints

    passage = "".join(chr(0x4E00 + (i * 37) % 900) for i in range(K + WINDOW - 1))
    run = "".join(chr(97 + (i * i + 3 * i) % 26) for i in range(K + WINDOW - 1))
    rows = [(n, "".join(chr(0x5E00 + (n * 11 + i) % 700) for i in range(n)) + passage) for n in range(1, 18)]
    rows += [(100 + n, "q" * (20 + n) + run + "w" * 20) for n in range(17)]
    got = {r.doc_id: {h for h, _ in r.fingerprint} for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for first in (1, 100):
        group = [v for i, v in got.items() if (i >= 100) == (first == 100)]
        assert all(group[0] & v for v in group)


def test_held_lines_are_bounded(spark, monkeypatch):
    """One document that repeats a line more often than a task holds rows, alone or with enough others."""
    from urbanlens.llm import line_dedup as D

    monkeypatch.setattr(D, "HELD", 50)
    rows = [(1, "often\n" * 400 + "end"), (2, "twice\n" * 300)] + [(10 + i, "often\nown") for i in range(9)] + [(30, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = defaultdict(set)
    for i, x in rows:
        for p, line in enumerate(x.split("\n")):
            if line:
                lines[line].add((i, p))
    for least in (2, 9, 10, 11):
        enough = {k: v for k, v in lines.items() if len({i for i, _ in v}) >= least}
        got = {(r.doc_id, r.position) for r in D.repeated_lines(docs, least).collect()}
        assert got == {x for v in enough.values() for x in v}
        kept = {(r.doc_id, r.position) for r in D.repeated_lines(docs, least, keep_first=True).collect()}
        assert kept == {x for v in enough.values() for x in v - {min(v)}}


def test_every_character_is_split_as_the_library_does():
    """Alone and between letters, newer ones than Python knows included."""
    import sys

    from urbanlens.llm.word_bpe import Merger, Vocabulary, Words

    v, t = Vocabulary(WORD), Tokenizer.from_file(WORD)
    words, merge = Words(v.special, WORD), Merger(v)
    known: dict = {}

    def ids(text):
        return [i for w in words(text) for i in (known[w] if w in known else known.setdefault(w, [v.special[w]] if w in v.special else merge(w)))]

    characters = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for form in ("{}", "a{}b"):
        wrong = []
        for at in range(0, len(characters), 50_000):
            texts = [form.format(c) for c in characters[at : at + 50_000]]
            wrong += [x for x, e in zip(texts, t.encode_batch_fast(texts, add_special_tokens=False), strict=True) if ids(x) != e.ids]
        assert not wrong, (form, len(wrong), wrong[:5])
