"""URL filters, neighbours, mixing, toxicity and the pipeline."""

import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def rule_of(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, 0, None, "allow"))[2:]


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    cut = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:cut]


URLS = [None, "", "no scheme", "http://", "http://A.Org", "http://a.org/", "https://example.org/es/x", "http://www.example.org/en/12?q=/x", "http://example.org/en/2", "http://xexample.org/es/", "ftp://u@b.com:80/fr/1", "http://com/de/", "http://x.com/de/?a://b", "http://É.COM/fr/#f", "http://a.b.c.org//"]


def test_url_filters(spark):
    from urbanlens.llm import url_filters as U
    from urbanlens.llm.queries import URL_RULES

    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS * 2)] + [(None, URLS[6], None, None)], "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(URL_RULES + URL_RULES[:1], "host string, path string, verdict string")
    want = Counter()
    for i, u in [*enumerate(URLS * 2), (None, URLS[6])]:
        host, path = parts_of(u)
        want[(i, host, path, *rule_of(host, path, URL_RULES))] += 1
    assert Counter(map(tuple, U.url_filter(pages, rules).collect())) == want
    assert U.url_filter(pages.limit(0), rules).count() == 0
    assert {r.rule for r in U.url_filter(pages, rules.limit(0)).collect()} == {None}


def test_cascade_is_exact_and_needs_levels(spark, monkeypatch):
    from urbanlens.llm import url_filters as U

    monkeypatch.setattr(U, "HASHES", 1)  # many false positives
    listed = spark.range(0, 400, 2).select(F.col("id").cast("string").alias("key"))
    universe = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    levels = U.build_cascade(listed, universe, 400)
    assert len(levels) > 2
    got = {int(r.key) for r in universe.filter(U.in_cascade(F.col("key"), levels)).collect()}
    assert got == set(range(0, 400, 2))


def test_first_filter_follows_the_universe(spark):
    """As many false positives as rules, about, whatever the corpus; so the second filter stays as small."""
    from urbanlens.llm import url_filters as U

    listed = spark.range(5).select(F.concat(F.lit("r"), "id").alias("key"))
    universe = spark.range(300_000).select(F.col("id").cast("string").alias("key"))
    levels = U.build_cascade(listed, universe, 300_000)
    assert all(len(words) <= 8 for _, _, words in levels)
    assert universe.unionByName(listed).filter(U.in_cascade(F.col("key"), levels)).count() == 5


def test_rules_of_many_shapes(spark):
    """Hundreds of path lengths are one expression, without a join."""
    from urbanlens.llm import url_filters as U

    rules = [("a.org", "/" + "x" * n, "block" if n % 2 else "allow") for n in range(300)] + [("org", "/", "allow"), ("b.a.org", "/x", "allow")]
    urls = [f"http://{'b.' * (n % 3)}a.org/{'x' * (n * 7 % 400)}{'y' * (n % 2)}" for n in range(120)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = U.url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert set(map(tuple, out.collect())) == {(i, *(p := parts_of(u)), *rule_of(*p, rules)) for i, u in enumerate(urls)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len(plan) < 60_000


def test_neighbours(spark):
    from urbanlens.llm.neighbours import nearest

    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 16)).astype("f4")
    x[300:700] = x[300]  # a very common vector
    rows = [(i, [float(v) for v in e], "z") for i, e in enumerate(x)]
    odd = [(5000, None, "z"), (5050, [0.0] * 16, "z"), (5100, [None] + [1.0] * 15, "z"), (5150, [float("nan")] * 16, "z"), (5200, [float("inf")] * 16, None), (None, [1.0] * 16, "z")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = x.astype("f8")
    norms, hit = np.linalg.norm(x, axis=1), 0
    assert sorted(got) == list(range(0, 1200, 50))
    for q, found in got.items():
        s = (x * x[q]).sum(axis=1) / (norms * norms[q])
        assert all(abs(s[v] - c) < 1e-12 for v, c in found) and q not in [v for v, _ in found]
        s[q] = -9
        want = np.lexsort((np.arange(1200), -np.round(s, 12)))[:5]
        hit += len(set(want.tolist()) & {v for v, _ in found})
        if 300 <= q < 700:  # ties go to the smaller ids
            assert [v for v, _ in found] == [v for v in range(300, 306) if v != q][:5]
    assert hit >= 0.9 * 5 * len(got)
    assert nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = nearest(table.filter("vec_id < 3 or vec_id > 4999"), F.col("vec_id") == 0).collect()
    assert [r.rank for r in few] == [1, 2]


def test_url_filters_of_many_keys(spark, monkeypatch):
    """More false positives of the first filter than rules."""
    from urbanlens.llm import url_filters as U
    from urbanlens.llm.queries import URL_RULES

    monkeypatch.setattr(U, "HASHES", 1)
    urls = URLS + [f"http://x{i}.example.org/{'es' if i % 3 else 'en'}/{i}" for i in range(3000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    want = {(i, *(p := parts_of(u)), *rule_of(*p, URL_RULES)) for i, u in enumerate(urls)}
    assert set(map(tuple, U.url_filter(pages, rules).collect())) == want


def nearest_of(vectors, queries, **how):
    from urbanlens.llm.neighbours import nearest

    got = defaultdict(list)
    for r in nearest(vectors, queries, **how).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    return got


def test_neighbours_where_lists_outnumber_the_beam(spark, monkeypatch):
    """The ratio decides what is read: one that spans all lists finds what brute force does."""
    from urbanlens.llm import neighbours as N

    monkeypatch.setattr(N, "BEAM", 8)
    x = np.random.default_rng(5).normal(size=(6000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest_of(table, F.col("vec_id") % 60 == 0, ratio=9.0)
    for q in range(0, 6000, 60):
        s = x @ x[q]
        s[q] = -9
        assert [v for v, _ in got[q]] == np.argsort(-s)[:5].tolist()


def test_neighbours_of_repeated_rows(spark):
    """Rows that are repeated, and rows of one id that score equally, take no places from other vectors."""
    x = np.random.default_rng(2).normal(size=(200, 8))
    rows = [(i, e.tolist()) for i, e in enumerate(x)]
    schema = "vec_id long, embedding array<double>"
    want = nearest_of(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0)
    assert [len(f) for f in want.values()] == [5] * 10
    assert nearest_of(spark.createDataFrame(rows * 6, schema), F.col("vec_id") % 20 == 0) == want
    twice = [(i, [v * 2.0**n for v in e]) for i, e in rows for n in range(7)]  # cosines stay the same
    assert nearest_of(spark.createDataFrame(twice, schema), F.col("vec_id") % 20 == 0, ratio=99.0) == want


@pytest.mark.parametrize("n", [10_000, 50_000])
def test_neighbours_recall_and_reads(spark, n):
    """The fitted ratio reaches the documented recall, on vectors without clusters, and reads a part of the vectors."""
    from urbanlens.llm.neighbours import nearest

    x = np.random.default_rng(9).normal(size=(n, 64)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}), "vec_id long, embedding array<float>")
    facts, every = {}, n // 200
    got = nearest_of(table, F.col("vec_id") % every == 0, seen=facts.update)
    hit, read = 0, 0
    for q in range(0, n, every):
        s = (x @ x[q]).astype("f8")
        s[q] = -9
        hit += len(set(np.argpartition(-s, 5)[:5].tolist()) & {v for v, _ in got[q]})
        far = np.sqrt(np.maximum(2 - 2 * (facts["graph"].centres @ x[q]), 0))
        read += facts["sizes"][far <= facts["ratio"] * far.min()].sum()
    queries = len(range(0, n, every))
    print(n, "recall", hit / (5 * queries), "postings", facts["postings"] / n, "share read", read / queries / facts["postings"], "ratio", facts["ratio"], "lists", facts["lists"])
    assert hit >= 0.95 * 5 * queries and read < 0.85 * queries * facts["postings"]


def test_lists_that_cannot_hold_a_neighbour_are_skipped(spark, monkeypatch):
    """Tight clusters far apart: whatever the ratio asks to read, the second step hands on next to nothing, and finds all."""
    from urbanlens.llm import neighbours as N

    monkeypatch.setattr(N, "FIRST", 1)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), 40, axis=0) + rng.normal(size=(1200, 24)) * 0.01
    table = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest_of(table, F.col("vec_id") % 50 == 0, ratio=99.0)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 1200, 50):
        s = u @ u[q]
        s[q] = -9
        assert [v for v, _ in got[q]] == np.argsort(-s)[:5].tolist()


def test_mixing(spark, odd_docs, no_docs):
    from urbanlens.llm.mixing import copies, mix

    rows = copies(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.taken == r.size * r.copies <= 2 * r.size for r in rows)
    total = sum(r.size for r in rows)
    by_source = {(r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in by_source) - 1.5 * total) < 1e-6 and all(t <= 2 * s for s, t in by_source)
    mixed = mix(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, mix(odd_docs).collect()))
    assert copies(no_docs).count() == 0 and mix(no_docs).count() == 0
    assert {r.taken for r in copies(odd_docs.withColumn("text", F.lit(""))).collect()} == {0}


def test_fuzzy_trie_by_brute_force():
    import random

    from urbanlens.llm.toxicity import FUZZY_LENGTH, FuzzyTrie

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    terms = ["pathetic", "scum", "ababab", "lostr*", "abcabc*"]
    trie, rnd = FuzzyTrie(terms), random.Random(2)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in range(1500)] + ["pathetic", "pathetik", "pthetic", "scum", "skum", "lostra", "lost", "lostrum"]
    for w in words:
        best = None
        for t in terms:
            stem = t.rstrip("*")
            most = int(len(stem) >= FUZZY_LENGTH)
            e = min(edits(w[:n], stem) for n in range(len(w) + 1)) if t.endswith("*") else edits(w, stem)
            if e <= most and (best is None or e < best):
                best = e
        found = trie.match(w)
        assert (found[0] if found else None) == best, w


def test_toxicity_learns_and_spares_quotations(spark):
    from urbanlens.llm.toxicity import features, toxicity, without_toxic

    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        words = [f"w{(i * 7 + k * k) % 97}" for k in range(40)]
        if bad:
            words[5] = words[20] = "grumblor"
            words[30] = "snarkoid"
        rows.append((i, " ".join(words), "x"))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    rows += [(1000, None, None), (1001, "", "x"), (1001, "", "x"), (1002, " ".join(["w1 w2"] * 5 + ["you grumblr snarkoit grumblor snarkoid"]), "x"), (None, "grumblor snarkoid grumblor", "x"), (1003, "word " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(2, None), (None, 1), (4, 7)], "doc_id long, toxic int")
    got = toxicity(docs, marks)
    found = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) and got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(found[i].predicted == int(i % 6 == 0) for i in range(600))
    assert found[1002].predicted == 1 and found[None].predicted == 1 and not found[1000].predicted and not found[1003].predicted
    left = without_toxic(docs, marks)
    assert left.columns == docs.columns and left.count() == sum(1 for r in got.collect() if not r.predicted)
    assert toxicity(docs.limit(0), marks).count() == 0
    assert {r.score for r in toxicity(docs, marks.limit(0)).collect()} == {0.0}
    plain, said = features("a grumblor here", {"grumblor": (0, 0)}), features('he said "a grumblor here" then', {"grumblor": (0, 0)})
    assert plain[0] > 0 and said[0] == 0 and said[2] > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op1_url_filters", "op4_line_dedup", "op7_near_dedup", "op8_source_mixing", "op13_ngram_join"])
def test_queries_match_their_sql(spark, duck, name):
    from urbanlens.llm.queries import QUERIES, SQL

    df = QUERIES[name](spark, SMALL)
    order = ", ".join(sorted(df.columns))
    want = duck.execute(f"select {order} from ({SQL[name]})").fetchall()
    assert Counter(map(tuple, df.select(*sorted(df.columns)).collect())) == Counter(want)


def test_pipeline_against_its_operators_by_brute_force(spark):
    """Each stage's rows follow from the stage before by plain Python."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as C
    from urbanlens.llm.common import table, written
    from urbanlens.llm.toxicity import toxicity

    docs = written(table(spark, SMALL, "documents").withColumn("rule", F.lit("own")), "t")
    toxic = {r.doc_id for r in toxicity(docs, table(spark, SMALL, "labels")).filter("predicted = 1").collect()}
    out = written(C.STAGES[0][1](spark, docs, SMALL), "t")
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - toxic
    rows = {r.doc_id: r.text for r in out.collect()}
    held = Counter(k for t in rows.values() for k in {x.strip(" \t\n\x0b\x0c\r").lower() for x in t.split("\n")} if k)
    want, met = {}, set()
    for i in sorted(rows):  # the first occurrence of a common line stays
        key = [x.strip(" \t\n\x0b\x0c\r").lower() for x in rows[i].split("\n")]
        want[i] = "\n".join(x for x, k in zip(rows[i].split("\n"), key, strict=True) if held[k] < 10 or k not in met and not met.add(k))
    out = written(C.STAGES[1][1](spark, out, SMALL), "t")
    assert {r.doc_id: r.text for r in out.collect()} == want and all(r.n_chars == len(r.text) for r in out.collect())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := t.lower().split()) else set() for i, t in want.items()}
    up = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = up[a], up[b]
                up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
    out = written(C.STAGES[2][1](spark, out, SMALL), "t")
    assert {r.doc_id for r in out.collect()} == {i for i in up if up[i] == i}
    before = Counter(r.doc_id for r in out.collect())
    out = written(C.STAGES[3][1](spark, out, SMALL), "t")
    after = Counter(r.doc_id for r in out.collect())
    assert set(after) <= set(before) and max(after.values()) <= 2 and out.columns == docs.columns
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = C.STAGES[4][1](spark, out, SMALL).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in coded) == Counter((r.doc_id, np.array(t.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()) for r in out.collect())


def test_pipeline_keeps_one_of_a_large_copy_group(spark):
    import corpus_pipeline as C
    from urbanlens.llm.common import written

    copied = "first line of the copied text\nsecond line of the same text\n"
    rows = [(i, copied) for i in range(25)] + [(100 + i, f"own words {i * i} of text {i}\nCommon line\n") for i in range(12)]
    rows += [(7, copied), (200, "common line"), (201, " \n"), (202, None)]
    clash = "_keep_doc int, _keep_text int, _keep_bitmap int, _near_doc int"
    docs = spark.createDataFrame([(i, t, len(t) if t else 0, 1, 2, 3, 4) for i, t in rows], f"doc_id long, text string, n_chars long, {clash}")
    out = written(C.line_dedup(spark, docs, SMALL), "t")
    assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {(1, 2, 3, 4)}
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in rows)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert all(r.n_chars == len(r.text or "") for r in out.collect())
    # the first copy has the lines, the others nothing but the blank last line; boilerplate stays where it came first
    assert texts[0] == copied and texts[24] == "" and texts[100] == "own words 0 of text 0\nCommon line\n"
    assert texts[103] == "own words 9 of text 3\n" and texts[200] == "" and texts[201] == " \n" and texts[202] is None
    kept = C.near_dedup(spark, out, SMALL)
    assert kept.columns == docs.columns


def test_pipeline_near_copies_keep_the_shared_text_once(spark):
    import corpus_pipeline as C

    shared = "\n".join(f"shared passage {i} of the text that all of them hold" for i in range(6))
    docs = spark.createDataFrame([(i, f"{shared}\nown line number {i * i} of document {i}", 0) for i in range(12)], "doc_id long, text string, n_chars long")
    texts = {r.doc_id: r.text for r in C.line_dedup(spark, docs, SMALL).collect()}
    assert texts[0].startswith(shared) and all(texts[i] == f"own line number {i * i} of document {i}" for i in range(1, 12))


def test_tokenizer_files_stay_outside():
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for d, _, names in os.walk(here) if ".git" not in d for f in names if f.endswith((".tiktoken", ".model")) or "bpe_" in f and f.endswith(".json")]
