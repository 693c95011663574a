"""Filter audit, centroid clustering and the n-gram join against brute force, SQL and odd rows."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import duckdb
import numpy as np
import pytest

SMALL = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_centroid_clusters"])
def test_queries_match_their_sql(spark, duck, name):
    from urbanlens.llm.queries import QUERIES, SQL

    df = QUERIES[name](spark, SMALL)
    order = ", ".join(sorted(df.columns))
    want = duck.execute(f"select {order} from ({SQL[name]})").fetchall()
    assert Counter(map(tuple, df.select(*sorted(df.columns)).collect())) == Counter(want)


# ---------------------------------------------------------------- filter audit
def failing(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = len(re.findall("[A-Z]", text))
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * capitals > 2 * len(text), "D": bool(re.search("[#$%&*|]", text))}


def audited(rows, labels):
    """By replaying every order on every row."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = []
    for i, t, s in rows:
        f = failing(t or "") | {"E": i is not None and i > least[t or ""]}
        docs.append((s or "", {c for c in f if f[c]}, any(d == i and q == 1 for d, q, _ in labels if i is not None), any(d == i and x == 1 for d, _, x in labels if i is not None)))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for n, c in enumerate(order):
                gone = [d for d in left if c in d[1]]
                redundant = sum(c in d[1] for d in mine) - len(gone)
                left = [d for d in left if c not in d[1]]
                out[part, "".join(order), n + 1] = [len(left), len(gone), redundant, sum(d[1] == {c} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                removed_by[c] += len(gone)
        for (p, order, n), row in out.items():
            if p == part:
                row.append(removed_by[order[n - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark, odd_docs, no_docs):
    from urbanlens.llm.filter_audit import audit

    labels = [(1, 1, 0), (1, 0, 1), (6, 1, None), (5, None, 1), (41, 1, 1), (999, 1, 1), (None, 1, 1), (21, 0, 0)]
    marks = spark.createDataFrame(labels, LABELS)
    shout = [(70, "LOUD " * 300, "s1"), (71, "LOUD " * 300, "s1"), (71, "LOUD " * 300, "s1"), (71, "other & text", "s2"), (None, "LOUD " * 300, None)]
    docs = odd_docs.unionByName(spark.createDataFrame(shout, "doc_id long, text string, source string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = audit(docs, marks)
    assert found.columns == columns
    assert {tuple(r[:3]): tuple(r[3:]) for r in found.collect()} == audited(rows, labels)
    assert audit(no_docs, marks).count() == 0
    assert {tuple(r[:3]): tuple(r[3:]) for r in audit(docs, marks.limit(0)).collect()} == audited(rows, [])


def test_positional_popcounts():
    from urbanlens.llm.filter_audit import positional_popcounts

    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 5, 1000):
        words, counts = rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 10_000, n)
        want = [int(((words >> np.uint32(b) & 1) * counts).sum()) for b in range(32)]
        assert positional_popcounts(words, counts).tolist() == want


def test_words_of_long_texts_are_cut_between_words():
    from urbanlens.llm.filter_audit import word_counts

    raw = b"  a bb\tccc a \n bb dddd\x0be  "
    for cut in (1, 2, 3, 7, 100):
        assert word_counts(raw, cut) == (7, 5)
    assert word_counts(b"x" * 50, 3) == (1, 1) and word_counts(b"") == (0, 0)


# ---------------------------------------------------------------- centroid clustering
def clustered(rows, clusters, rounds):
    """(vec_id, cluster, distance) by plain integers."""
    kept = [(i, np.floor(np.array(e, "f8") * 64).astype(object)) for i, e in rows]
    kept = [(i, [int(x) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), (r[0] is not None, r[0] or 0), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        sums, sizes = defaultdict(lambda: [0] * len(kept[0][1])), Counter()
        for _, v in kept:
            _, n = near(v)
            sizes[n] += 1
            sums[n] = [a + b for a, b in zip(sums[n], v, strict=True)]
        centroids = [[x // sizes[n] for x in sums[n]] if sizes[n] else c for n, c in enumerate(centroids)]
    found = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    inertia = Counter()
    for _, n, d in found:
        inertia[n] += d
    return Counter((i, n, d, inertia[n], sum(inertia.values()), sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in found)


def test_clusters(spark):
    from urbanlens.llm.centroids import clusters_of

    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(150, 4)), 3)
    x[40:90] = x[40]  # a hot vector
    x[90:95] = [[1.0, 1, 1, 1], [-1, -1, -1, -1], [0, 0, 0, 0], [1, -1, 1, -1], [-0.001, 0.001, 0, 0]]
    rows = [(i, e.tolist()) for i, e in enumerate(x)] + [(3, x[3].tolist()), (3, x[5].tolist()), (None, x[7].tolist())]
    odd = [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [1.0, float("nan"), 1.0, 1.0]), (905, [float("-inf")] * 4)]
    schema = "vec_id long, embedding array<double>, cluster string"
    vectors = spark.createDataFrame([(i, e, "clash") for i, e in rows + odd], schema)
    for clusters, rounds in ((16, 3), (2, 1), (3, 0)):
        got = clusters_of(vectors, clusters=clusters, rounds=rounds, size=4)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert Counter(map(tuple, got.collect())) == clustered(rows, clusters, rounds)
    few = spark.createDataFrame([(i, e, "x") for i, e in rows[:5]], schema)
    assert Counter(map(tuple, clusters_of(few, size=4).collect())) == clustered(rows[:5], 16, 3)
    assert clusters_of(vectors.limit(0), size=4).count() == 0 and clusters_of(vectors, size=5).count() == 0
    huge = spark.createDataFrame([(1, [1e300] * 4, "x"), (2, [-1e300] * 4, "x")], schema)
    assert {r.distance for r in clusters_of(huge, clusters=1, rounds=0, size=4).collect()} == {0, 4 * (1 << 28) ** 2}


def test_an_emptied_cluster_keeps_its_centroid(spark):
    from urbanlens.llm.centroids import moved

    points = spark.createDataFrame([(1, [5, -7]), (2, [6, -8])], "vec_id long, v array<bigint>")
    assert moved(points, [[5, -8], [5, -8], [900, 900]], 2) == [[5, -8], [5, -8], [900, 900]]


def test_clustering_stays_in_the_jvm(spark):
    from urbanlens.llm.queries import QUERIES

    plan = QUERIES["op12_centroid_clusters"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---------------------------------------------------------------- n-gram join
def word_sets(rows, words):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set()))
    return out


def joined(rows, words, percent):
    """(doc_id, n_shingles, component_id) by all pairs; the rows of one id are nodes of one name."""
    sets = word_sets(rows, words)
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return Counter((i, len(s), root(i) if i is not None else None) for i, s in sets)


def test_ngram_join(spark, odd_docs, no_docs):
    from urbanlens.llm.set_join import joined_documents

    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for words, percent, chunk in ((4, 85, 64), (5, 80, 2), (2, 50, 3)):
        got = Counter(map(tuple, joined_documents(odd_docs, words, percent, chunk).collect()))
        assert got == joined(rows, words, percent), (words, percent)
    assert joined_documents(no_docs).count() == 0
    assert Counter(map(tuple, joined_documents(odd_docs.filter("doc_id in (1, 2, 3)")).collect())) == Counter([(1, 0, 1), (2, 0, 2), (3, 0, 3)])


def near_copies(n, words=60, seed=1):
    """A base text and copies with a few edits each, of which many aren't similar enough to the base."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(rnd.randrange(0, 5) if i else 0):
            t[rnd.randrange(words)] = f"x{rnd.randrange(200)}"
        rows.append((i, " ".join(t)))
    return rows


def test_ngram_join_of_a_large_group(spark):
    """Groups of near copies that one hub doesn't hold together, in blocks of a few classes; chains; unlike sizes."""
    from urbanlens.llm.set_join import joined_documents

    rows = near_copies(160) + [(1000 + i, t) for i, t in near_copies(60, 25, 2)]
    chain = [f"c{i}" for i in range(150)]
    rows += [(2000 + i, " ".join([f"v{j}" for j in range(3 * i)] + chain[3 * i :])) for i in range(30)]
    rows += [(3000 + i, " ".join([f"s{j}" for j in range(100 + 2 * i)])) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, chunk in ((85, 8), (80, 64)):
        got = Counter(map(tuple, joined_documents(docs, 4, percent, chunk).collect()))
        assert got == joined(rows, 4, percent)


def test_overlaps_and_derived_answers():
    from urbanlens.llm.blocks import answers, overlaps, without

    rng = np.random.default_rng(6)
    hub = np.unique(rng.integers(0, 400, 120).astype(np.uint64))

    def edited(x, n):
        return np.unique(np.concatenate([rng.choice(x, len(x) - n, replace=False), rng.integers(400, 500, n).astype(np.uint64)]))

    members = [edited(hub, n) for n in (0, 3, 9, 20)] * 3
    others = [edited(hub, n) for n in (1, 5, 12, 30)] + [np.unique(rng.integers(0, 900, 90).astype(np.uint64)), np.empty(0, np.uint64)]
    exact = np.array([[len(np.intersect1d(a, b)) for b in members] for a in others])
    assert (overlaps(others, members) == exact).all() and overlaps([], members).shape == (0, len(members))
    n, m = np.array([len(x) for x in others]), np.array([len(x) for x in members])
    plus, minus = [without(x, hub) for x in members], [without(hub, x) for x in members]
    for percent in (50, 80, 85, 95):
        linked = 100 * exact >= percent * (n[:, None] + m[None, :] - exact)
        assert (answers(others, n, hub, plus, minus, m, np.ones_like(linked), percent) == linked).all()


def test_near_duplicates_of_a_large_group(spark):
    """2,000 near copies, most of them unlike each other: their components are those of all pairs."""
    from urbanlens.llm.near_dedup import near_duplicates, shingles

    rows = near_copies(2000, 60) + [(5000, " ".join(f"w{i}" for i in range(50, 110)))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    sets = {i: shingles(t, 3) for i, t in rows}
    words, of = np.unique(np.concatenate(list(sets.values())), return_inverse=True)
    table = np.zeros((len(rows), len(words)), np.float32)
    table[np.repeat(np.arange(len(rows)), [len(s) for s in sets.values()]), of] = 1
    both, n = table @ table.T, table.sum(axis=1)
    linked = 100 * both >= 85 * (n[:, None] + n[None, :] - both)
    names = np.arange(len(rows))
    while True:
        least = np.where(linked, names[None, :], len(rows)).min(axis=1)
        if (least == names).all():
            break
        names = least
    ids = np.array([i for i, _ in rows])
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(int(i), int(m), int(ids[c]), bool(i == ids[c])) for i, m, c in zip(ids, n, names, strict=True)}


def test_collisions_are_counted_whole_where_they_matter():
    from urbanlens.llm.near_dedup import COORDINATES, collide

    rng = np.random.default_rng(8)
    a, b = (rng.integers(0, k, (m, COORDINATES)) for m, k in ((30, 3), (41, 2)))
    b[:9] = a[:9]
    b[4, ::3] = -1
    for matches in (1, 20, 26, 42, 64):
        assert (collide(a, b, matches) == ((a[:, None] == b[None]).sum(axis=2) >= matches)).all()


def test_block_pairs_are_dealt_by_both_names(spark):
    from urbanlens.llm.blocks import met

    pairs = spark.createDataFrame([(1, 2), (1, 1)], "i long, j long")
    rows = spark.createDataFrame([(1, 7), (2, 8)], "block long, rep long")
    found = met(pairs, rows, lambda a, b: [(int(a["rep"].iloc[0]), -1 if b is None else int(b["rep"].iloc[0]))])
    assert {tuple(r) for r in found.collect()} == {(7, 8), (7, -1)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(i#\d+L?, j#\d+L?", plan)


def test_components_of_many_shapes(spark, monkeypatch):
    from urbanlens.llm import components as C

    rnd = random.Random(5)
    for size in (1, 1 << 17):  # links by links, or whole partitions, joined first
        monkeypatch.setattr(C, "SLICE", size)
        links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1000) for i in range(80)] + [(2000 + i, 2001 + i) for i in range(40)]
        groups = C.Joined()
        for a, b in links:
            groups.join(a, b)
        want = {(x, groups.root(x)) for a, b in links if a != b for x in (a, b)}
        assert {(r.node, r.component) for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- toxicity, piece by piece
def test_window_features_by_brute_force():
    import math

    from urbanlens.llm.toxicity import features

    rnd = random.Random(7)
    matched = {"scum": (0, 0), "skum": (1, 0), "vile": (0, 1), "rot": (0, 2), "wile": (1, 1)}
    words = [*matched, *(f"w{i}" for i in range(12))]
    for _ in range(300):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", ", ", '"', ' "', "“", "” ", "\n", "   " * 9]) for _ in range(rnd.randrange(0, 60)))
        hits = [(m.start(), m.end(), *matched[m[0]]) for m in re.finditer(r"[^\W_]+", text) if m[0] in matched]

        def quoted(start, end, text=text):
            line, rest = text[max(0, start - 60) : start].split("\n")[-1], text[end : end + 60].split("\n")[0]
            return sum(line.count(c) for c in "\"“”„«»‹›‘") % 2 == 1 and any(c in rest for c in "\"“”«»‹›’")

        kind = ["quoted" if quoted(s, e) else "fuzzy" if edits else "exact" for s, e, edits, _ in hits]
        worth = [{"quoted": 0.25, "fuzzy": 0.5, "exact": 1.0}[k] for k in kind]
        best = max((sum(w for (t, *_), w in zip(hits, worth, strict=True) if s - 120 <= t <= s) for s, *_ in hits), default=0)
        want = [math.log1p(kind.count(k)) for k in ("exact", "fuzzy", "quoted")] + [min(len({h[3] for h in hits if not h[2]}), 5) / 5, math.log1p(best)]
        assert np.allclose(features(text, matched), want), text


def test_terms_are_chosen_greedily():
    from urbanlens.llm.toxicity import choose_terms

    rnd = random.Random(8)
    for _ in range(60):
        names = [f"{a}{b}ord{c}" for a in "abc" for b in "xy" for c in "12"]
        found = [rnd.sample(names, rnd.randrange(0, 5)) for _ in range(rnd.randrange(1, 60))]
        clean = {t: rnd.randrange(0, 2) for t in names}
        chosen = choose_terms(found, clean)
        held = Counter()
        left = {t for f in found for t in f}
        for t in chosen:  # none stems from another here, so each step is a plain maximum
            gain = {u: sum(u in f and held[i] < 2 for i, f in enumerate(found)) - 5 * clean[u] for u in left}
            assert gain[t] == max(gain.values()) >= 3
            left.discard(t)
            held.update(i for i, f in enumerate(found) if t in f)
        assert all(sum(u in f and held[i] < 2 for i, f in enumerate(found)) - 5 * clean[u] < 3 for u in left)


def test_fit_is_a_stationary_point():
    from urbanlens.llm.toxicity import _fit

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=300) > 0).astype(float)
    weight = rng.uniform(0.5, 2, 300)
    w = _fit(x, y, weight)
    full = np.hstack([np.ones((300, 1)), x])
    ridge = np.r_[1e-6, np.full(4, 1e-3)] * weight.sum()
    assert np.abs(full.T @ (weight * (1 / (1 + np.exp(-full @ w)) - y)) + ridge * w).max() < 1e-5


def test_learning_takes_one_text_an_id(spark):
    """However often a labelled row is repeated, the bounded sample stays bounded, and what is learned the same."""
    from urbanlens.llm.toxicity import learn

    rows = [(i, " ".join([f"w{(i * 7 + k * k) % 97}" for k in range(30)] + (["grumblor", "snarkoid"] if i % 5 == 0 else []))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    once, often = learn(docs, marks), learn(docs.unionByName(docs.filter("doc_id < 20")).unionByName(docs.filter("doc_id < 20")), marks)
    assert once[0] == often[0] and np.allclose(once[1], often[1])
