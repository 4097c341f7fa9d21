"""Lexical search, the prefix trie and toxicity against brute force and held-out labels, on tables with hard cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tambo.llm import lexical, prefix_trie, toxicity
from tambo.llm.queries import QUERIES

from conftest import SF_SMALL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
rnd = random.Random(7)


# ------------------------------------------------------------------ 11 lexical search
def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_search(docs, items, k=10):
    docs = [(i, terms(x)) for i, x in docs]
    n_docs, total = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = Counter(w for _, t in docs for w in set(t))
    counted = [(i, len(t), Counter(t)) for i, t in docs if t]
    out = []
    for item, text in items:
        found = []
        for i, n, c in counted:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
                        for w, r in Counter(terms(text)).items() if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


VOCABULARY = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(2000)]
DOCS = [(i, " ".join(rnd.choices(VOCABULARY, k=rnd.choice([0, 1, 5, 50, 200]))) + rnd.choice(["", " É中 X!"])) for i in range(400)]
DOCS += [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2"), (None, "w3"), (7000, None), (7001, ""), (7002, "!?")]
DOCS += [(8000, " ".join(VOCABULARY) * 20)] + [(9000 + i, "w1 w2 w3 w4 É") for i in range(200)]
ITEMS = [(i, " ".join(rnd.choices(VOCABULARY, k=rnd.choice([1, 3, 20, 60])))) for i in range(40)]
ITEMS += [(0, "w1 w2"), (None, "w1 w1 W1 É"), (77, None), (78, ""), (79, "zzz"), (80, "w3 w4 w1 w2 É")]


@pytest.fixture(scope="module")
def searched(spark):
    docs = spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id bigint, text string, score string").repartition(5)
    return docs, spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id bigint, text string, doc_id string")


@pytest.mark.parametrize("sizes", [{}, {"seed": 1}, {"seed": 3}, {"block_bytes": 1200}])
def test_search_equals_brute_force(searched, sizes):
    got = lexical.search(*searched, **sizes).collect()
    assert sorted(map(tuple, got), key=repr) == brute_search(DOCS, ITEMS)


def test_search_in_small_groups_of_items(searched, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 3000)
    assert sorted(map(tuple, lexical.search(*searched, k=3).collect()), key=repr) == brute_search(DOCS, ITEMS, 3)


def test_search_empty_tables(searched):
    docs, items = searched
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.withColumn("doc_id", F.col("doc_id").cast("string")), items.filter("item_id = 0")).count() == 20


def test_node_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    rows = np.where(rng.random((300, 60)) < 0.1, rng.integers(1, 10**6, (300, 60)), 0).astype(float)
    items = [(np.sort(rng.choice(60, 5, replace=False)), rng.integers(1, 9000, 5)) for _ in range(50)]
    queries = lexical.Queries(items, 60)
    exact = rows @ queries.rows.T.astype(float)
    docs = lexical.Tree(rows)
    for d, level in enumerate(docs.levels):
        width = docs.leaf * docs.fan ** (len(docs.levels) - 1 - d)
        for at, node in enumerate(level):
            assert (node >= rows[at * width:(at + 1) * width]).all()
    kth = np.sort(exact, axis=0)[-3].astype(np.int64)
    seen = defaultdict(list)
    queries.search(rows, kth, lambda r, c, s: [seen[i].append((d, x)) for d, i, x in zip(r, c, s)])
    for i in range(50):
        assert sorted(seen[i]) == [(d, int(exact[d, i])) for d in range(300) if exact[d, i] >= kth[i] and exact[d, i] > 0]
    calls = []
    queries.search(rows, np.full(50, 1 << 60), lambda r, c, s: calls.append(r))
    assert not calls


# ------------------------------------------------------------------ 12 prefix trie
def brute_trie(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            key = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16] + len(x).to_bytes(4, "big")
            convs.setdefault(c, []).append(((t is not None, t or 0, key), (r, x)))
    convs = {c: [y for _, y in sorted(v)] for c, v in convs.items()}
    new = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, v in new.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += p not in children
        saved[p] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(new[c]) == len(p)))).encode()).hexdigest())
                   for p, m in members.items()), key=repr)


def trie_rows(df, **sizes):
    found = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_paths(df)), **sizes)
    return sorted(map(tuple, found.select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends").collect()), key=repr)


TURNS = [(c, rnd.choice([t, t, t, None, 1]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["a", "b", "", None, "ccc", "x" * 50]))
         for c in [*range(200), -5, -100, -101, None] for t in range(rnd.choice([1, 2, 2, 3, 5, 8]))]
TURNS += [(1000 + i, t, "user", "same") for i in range(300) for t in range(7)]          # a hot conversation
TURNS += [(2000 + i, t, "user", "same" if t == 0 else f"{i} {t}") for i in range(300) for t in range(2)]      # a hot first turn
TURNS += [(5000, t, "u", str(t % 3)) for t in range(300)] + [(7, 0, "user", "y" * 300_000)]


@pytest.mark.parametrize("part_bytes", [1 << 23, 9000, 400])
def test_trie_equals_brute_force(spark, part_bytes):
    df = spark.createDataFrame([(*r, "p", 1) for r in TURNS], "conv_id bigint, turn bigint, role string, text string, path string, part int")
    assert trie_rows(df.repartition(4), part_bytes=part_bytes) == brute_trie(TURNS)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert trie_rows(empty) == []
    assert trie_rows(spark.createDataFrame([(None, 0, "a", "b")], empty.schema)) == []


def test_radix_tree_layouts_and_paths():
    keys = sorted({bytes(rnd.choices(range(rnd.choice([2, 256])), k=rnd.choice([0, 20, 40]))) for _ in range(3000)}
                  | {b"\0" * 19 + bytes([b]) for b in range(256)} | {b"\2" * 19 + bytes([b]) for b in range(30)})
    root = prefix_trie.Node(b"", 0)
    for i, key in enumerate(keys):
        assert prefix_trie.insert(root, key, i).end == len(key)
    kinds, found, stack = set(), {}, [(root, 0)]
    while stack:
        node, start = stack.pop()
        kinds.add((type(node.kids).__name__, node.kids.room))
        if node.convs is not None:
            found[node.key[:node.end]] = list(node.convs)
        for mark, kid in node.kids.items():
            assert kid.key[node.end] == mark and kid.end > node.end and kid.key[:node.end] == node.key[:node.end]
            stack.append((kid, node.end))
    assert found == {k: [i] for i, k in enumerate(keys)}
    assert kinds == {("Sorted", 4), ("Sorted", 16), ("Indexed", 48), ("Direct", 256)}


# ------------------------------------------------------------------ 13 toxicity
def test_label_model_finds_accuracies_and_correlations():
    """Planted: four independent voters and two copies of the fourth; a third of the labels are known."""
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.2
    accuracy = [0.95, 0.9, 0.8, 0.7]
    votes = np.stack([np.where(rng.random(6000) < a, y, ~y) for a in accuracy], axis=1)
    votes = np.concatenate([votes, votes[:, 3:], votes[:, 3:]], axis=1)
    plus, minus = votes @ (1 << np.arange(6)), (~votes) @ (1 << np.arange(6))
    label = np.where(rng.random(6000) < 0.33, y, -1)

    batch = pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (plus, minus, label, np.ones(6000))], ["a", "b", "c", "d"])
    model = None
    for _ in range(5):
        sums = np.zeros(2 * 18 * 18)
        for out in toxicity._weigh(model, 6, True)(iter([batch])):
            sums[out.column(0).to_numpy()] = out.column(1).to_numpy()
        model = toxicity.LabelModel.fit(sums.reshape(2, 18, 18))
    got = model.accuracies(sums.reshape(2, 18, 18), list("abcdef"))
    assert all(abs(got[n] - a) < 0.03 for n, a in zip("abcdef", accuracy + [0.7, 0.7])) and abs(model.prior - 0.2) < 0.03
    links = {frozenset(x) for x in model.order if x[1] >= 0}
    assert len(links & {frozenset({3, 4}), frozenset({3, 5}), frozenset({4, 5})}) == 2
    # The copies add nothing: the posterior is that of the four independent voters, by Bayes' rule.
    states = toxicity.states(plus, minus, 6)
    posterior = model.posterior(states, np.full(6000, -1))
    odds = np.log(0.2 / 0.8) + sum(np.where(votes[:, j], 1, -1) * np.log(a / (1 - a)) for j, a in enumerate(accuracy))
    assert np.abs(posterior - 1 / (1 + np.exp(-odds))).max() < 0.15


def test_markers_are_beginnings_that_mark_the_class():
    counts = {"idio": (40, 0), "idiot": (40, 0), "idiot$": (30, 0), "the": (90, 900), "scum$": (9, 0), "rare": (3, 0)}
    assert toxicity.choose_markers(counts, 100, 1000) == ["idiot", "scum$"]


def test_logistic_meets_its_optimum():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=(500, 3)), np.ones(500)])
    target = 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0, -0.5])))
    w = toxicity.logistic(x, target, ridge=1e-6)
    assert np.abs(w - [2.0, -1.0, 0.0, -0.5]).max() < 1e-3


def test_toxicity_hard_cases(spark):
    clean = "a plain text about the weather of today and nothing else number"
    texts = [(i, f"{clean} {i}") for i in range(200)] + [(i, f"{clean} {i} zorkand {'and zorkish ' * (i % 3)}") for i in range(200, 260)]
    texts += [(900, None), (901, ""), (902, "12 !? 34"), (None, "a zorkand zorkish today"), (900, clean), (903, clean * 20_000),
              (904, (clean + " zorkand zorkish ") * 5000)]
    docs = spark.createDataFrame([(*t, "x", "y") for t in texts], "doc_id bigint, text string, doc string, score string").repartition(4)
    marks = [(i, int(200 <= i < 260), "t") for i in range(260)] + [(900, None, "t"), (None, 1, "t"), (3, 0, "t")]
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int, text string")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc is not None and zlib.crc32(str(r.doc).encode()) % 4 == 2)
        assert (r.score >= 0.3) == (r.doc is None or 200 <= r.doc < 260 or r.doc == 904), r
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    plain = {r.doc: r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()}
    assert len(plain) == len({t[0] for t in texts})


def test_toxicity_reads_no_held_out_label(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    flipped = labels.withColumn("toxic", F.when(hidden, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    rows = [sorted(map(tuple, toxicity.score_toxicity(docs, x).collect())) for x in (labels, flipped)]
    assert rows[0] == rows[1]


def test_toxicity_held_out_accuracy(spark):
    sf = SF_SMALL.replace("0.001", "0.1")
    got = QUERIES["op13_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    right = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert right[1, 1] / (right[1, 1] + right.get((1, 0), 0)) > 0.9
    assert right[0, 0] / (right[0, 0] + right.get((0, 1), 0)) > 0.99


def test_arrays_of_a_search_task_are_bounded():
    import tracemalloc

    make = np.random.default_rng(1)
    items = [(np.sort(make.choice(4000, 40, replace=False)), np.full(40, 5000)) for _ in range(200)]
    docs = pa.RecordBatch.from_arrays([pa.array(range(2200)), pa.array([60] * 2200),
                                       pa.array([make.choice(4000, 30, replace=False) for _ in range(2200)], pa.list_(pa.int32())),
                                       pa.array([[1] * 30] * 2200, pa.list_(pa.int32()))], ["doc", "n", "terms", "tfs"])
    task = lexical.search_task(items, 4000, 2200, 2200 * 60, np.zeros(200, np.int64), 10)
    tracemalloc.start()
    found = sum(b.num_rows for b in task(iter([docs])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 2000 and peak < 64_000_000
