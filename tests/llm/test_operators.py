"""Each operator against brute force, a library or an exact round trip, on tables with hard cases."""

import hashlib
import itertools
import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tambo.llm import chat, decontaminate, langid, lcp, licenses, packing, sharding, simhash, token_counts, warc
from tambo.llm.components import components

DOCS = "doc_id bigint, text string, lang string, key string, fp string, length string, `__n_words` string"
LONG = " ".join(f"w{i % 977} the" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the angry old farmer today", "en"),
    (1, "The quick brown fox jumps over the lazy dog and runs away from the angry old farmer today", "en"),
    (1, "another text under an id that is used again", "en"),
    (2, None, "en"), (3, "", None), (4, " \t\n ", "de"), (5, "???", "de"), (6, LONG, "en"), (7, "aaaa" * 5000, None),
    (None, "a text without an id", "en"), (8, "Straße ÉCOLE naïve 中文 👍 ok", "fr"), (9, "x", "en"),
    (10, "<|endoftext|>hi <|endoftext|> there", "en"), (11, "the quick brown fox jumps over the lazy dog and runs away from "
                                                            "the angry old farmer today", "en"),
]


def table(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, la, "k", "f", "l", "n") for i, t, la in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string, doc string")


# ------------------------------------------------------------------ 1 decontamination
def norm_words(text):
    import re
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute_contamination(texts, bench, n=13):
    windows = {}
    for item, text in bench:
        w = norm_words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add(str(item))
    out = []
    for doc, text in texts:
        w, hit, found = norm_words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(w[i:i + k])]
        out.append((doc, len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


BENCH = [(1, "brown fox jumps over the lazy dog and runs away from the angry old farmer", None), (1, "x", None),
         (20, "Straße école", None), (3, None, None), (4, "", None), (5, "fox jumps over the lazy dog and runs away from the angry old", "e"),
         (5, "fox jumps over the lazy dog and runs away from the angry old", "e"), (None, "lazy dog", None)]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_contamination_equals_brute_force(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_BYTES", limit)
    bench = [b for b in BENCH if b[0] is not None]
    got = decontaminate.contamination(docs, items(spark, bench)).collect()
    rows = sorted(((r.doc, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got), key=repr)
    assert rows == brute_contamination([(i, t) for i, t, _ in TEXTS], [b[:2] for b in bench])


@pytest.mark.parametrize("limit", [200_000, 0])
def test_items_without_an_id_count_as_one(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_BYTES", limit)
    bench = [*BENCH, (None, "the angry old farmer", None)]
    got = decontaminate.contamination(docs, items(spark, bench)).collect()
    rows = sorted(((r.doc, r.n_words, r.n_hit, tuple(sorted(map(str, r["items"]))), r.contaminated) for r in got), key=repr)
    assert rows == brute_contamination([(i, t) for i, t, _ in TEXTS], [b[:2] for b in bench])
    assert all(r.n_items == len(r["items"]) and None not in r["items"][:-1] for r in got) and any(None in r["items"] for r in got)


def test_contamination_empty_tables(spark, docs, none):
    assert decontaminate.contamination(none, items(spark, BENCH)).count() == 0
    clean = decontaminate.contamination(docs, items(spark, [])).collect()
    assert len(clean) == len(TEXTS) and not any(r.contaminated or r.n_hit or r["items"] for r in clean)


def test_decontaminate_documents_and_spans(spark, docs):
    bench = items(spark, [(1, BENCH[0][1], None)])
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, t, _ in TEXTS if not (t or "").lower().startswith("the quick")), key=repr)
    cut = {(r.doc_id, r.text) for r in decontaminate.decontaminate(docs, bench, mode="remove_spans").collect()}
    assert (11, "the quick today") in cut and (6, LONG) in cut and (2, None) in cut


# ------------------------------------------------------------------ 2 licenses
def test_license_scan(spark, none):
    mit = dict(licenses.TEMPLATES)["MIT"]
    texts = [(1, "intro words é " + mit.replace("publish", "print") + " and a tail", None), (2, mit[:300], None), (3, None, None), (4, "", None),
             (5, LONG + " Released under the MIT License. " + LONG, None), (5, "Released under the MIT License. Released under the mit license", None),
             (6, "the terms of the license and of the software without any conditions", None)]
    got = licenses.scan_licenses(table(spark, texts)).collect()
    found = sorted((r.doc, r.licenses) for r in got)
    assert found == [(1, ["MIT"]), (2, []), (3, []), (4, []), (5, ["MIT notice"]), (5, ["MIT notice"]), (6, [])]
    one = next(r for r in got if r.doc == 1).matches[0]
    assert texts[0][1][one.start_char:one.end_char].startswith("Permission is") and 0.98 < one.coverage < 1
    assert sorted(r.n_matches for r in got if r.doc == 5) == [1, 2]
    long = next(r for r in got if r.doc == 5 and r.n_matches == 1).matches[0]
    assert texts[4][1][long.start_char:long.end_char] == "Released under the MIT License"
    assert licenses.scan_licenses(none).count() == 0


def edited(words, share, rng):
    """``words`` with ``share`` of them put in, left out or replaced, in equal parts."""
    out = []
    for w in words:
        kind = rng.choice(["in", "out", "other"]) if rng.random() < share else None
        out += {"in": ["zzz", w], "out": [], "other": ["zzz"], None: [w]}[kind]
    return out


def test_license_copies_with_repeated_phrases():
    rng = random.Random(4)
    phrases = [[f"p{i}{j}" for j in range(4)] for i in range(6)]
    own = [w for i in range(300) for w in (*rng.choice(phrases), f"u{rng.randrange(80)}", f"v{i}")]
    index, head = licenses.Index([("long", " ".join(own))]), [f"h{i}" for i in range(40)]
    for share in (0, 0.05, 0.1, 0.15):
        copy = edited(own, share, rng)
        text = " ".join([*head, *copy, "between", *own, *head, *copy])
        found = licenses.scan([text.encode(), " ".join(own[:700]).encode()], index)
        assert len(found[0]) == 3 and found[1] == [], share
        for m, first in zip(found[0], (40, 41 + len(copy), 81 + len(copy) + len(own))):
            assert abs(m["start_word"] - first) <= 3 and m["coverage"] >= 1 - share
        assert found[0][1]["coverage"] == 1


#: The license lines of the documents table.
TABLE_LINES = [("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."), ("All rights reserved", "All rights reserved."),
               ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."), ("MIT notice", "Released under the MIT License."),
               ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0.")]


def test_every_template_and_table_line(spark):
    cases = [*licenses.TEMPLATES, *TABLE_LINES]
    assert len(dict(licenses.TEMPLATES)) == len(licenses.TEMPLATES) and "GPL-3.0" in dict(licenses.TEMPLATES)
    texts = [(i, f"Some words before.\n{text}\nand some after.", None) for i, (_, text) in enumerate(cases)]
    for r in licenses.scan_licenses(table(spark, texts)).collect():
        name, text = cases[r.doc]
        own = [m for m in r.matches if m.template == name]
        assert name in r.licenses and own[0].coverage == 1 and own[0].start_word == 3, name
        assert licenses.words([texts[r.doc][1][own[0].start_char:own[0].end_char].encode()])[2].tolist() == licenses.words([text.encode()])[2].tolist()


NEIGHBOURS = [
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA-4.0 notice"]),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", ["CC-BY-4.0 notice"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", []),
    ("This work is licensed under a Creative Commons Attribution 3.0 International License", []),
    ("This work is licensed under the GNU General Public License, version 2", ["GPL-2.0 notice"]),
    ("This work is licensed under the GNU General Public License, version 3.0", ["GPL-3.0 notice"]),
    ("This work is licensed under the GNU General Public License, version 2.3", []),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1", []),
    ("This work is licensed under the GNU Lesser General Public License, version 3. Licensed under CC BY-NC-SA 4.0",
     ["CC-BY-NC-SA-4.0 short notice", "LGPL-3.0 notice"]),
    ("Released under the BSD License. Released under the MIT License", ["MIT notice"]), ("Released under the BSD License", []),
    ("Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0", ["CC-BY-4.0 short notice", "CC-BY-NC-4.0 notice"]),
    (dict(licenses.TEMPLATES)["All rights reserved notice"], ["All rights reserved notice"]),
    (dict(licenses.TEMPLATES)["GPL-2.0"], ["GPL-2.0"]), (dict(licenses.TEMPLATES)["LGPL-2.1"], ["LGPL-2.1"]),
    # Put into a longer text, but not part of it.
    (dict(licenses.TEMPLATES)["MIT"].replace("THE SOFTWARE IS", "Licensed under CC BY 4.0. THE SOFTWARE IS"), ["CC-BY-4.0 short notice", "MIT"]),
]


def test_like_licenses_are_told_apart(spark):
    texts = [(i, f"Some words. {text}. More words", None) for i, (text, _) in enumerate(NEIGHBOURS)]
    got = {r.doc: r for r in licenses.scan_licenses(table(spark, texts)).collect()}
    assert [(t, got[i].licenses) for i, (t, _) in enumerate(NEIGHBOURS)] == NEIGHBOURS
    of = {m.template for m in got[13].lesser}
    assert "GPL-1.0" in of and got[13].n_matches == 1 and {m.template for m in got[12].lesser} == {"All rights reserved"}


def brute_path(text, own):
    """Best score and matched words of local paths."""
    above, best = [(0, 0)] * (len(text) + 1), (0, 0)
    for w in own:
        row = [(0, 0)]
        for j, x in enumerate(text):
            gaps = [(above[j + 1][0] - 1, above[j + 1][1]), (row[j][0] - 1, row[j][1])]
            row.append(max((0, 0), (above[j][0] + (2 if x == w else -1), above[j][1] + (x == w)), *gaps))
            row[-1] = row[-1] if row[-1][0] else (0, 0)
        best, above = max(best, *row), row
    return best


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(60):
        text, own = (rng.integers(0, 5, rng.integers(1, n)).astype(np.uint64) for n in (30, 20))
        a, b = licenses.align(text, own, -len(own), len(text), 0, len(text))
        assert len(a) == brute_path(text.tolist(), own.tolist())[1] and (text[a] == own[b]).all()
        assert (np.diff(a) > 0).all() and (np.diff(b) > 0).all()


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        gram, text = rng.integers(0, 9, n).astype(np.uint64), np.sort(rng.integers(0, 3, n))
        kept = set(licenses.winnow(gram, text, 3).tolist())
        for i in range(n - 2):
            if text[i] == text[i + 2]:
                best = max(range(i, i + 3), key=lambda j: (-int(gram[j]), j))
                assert best in kept


# ------------------------------------------------------------------ 3 token counts
def test_token_counts_equal_library(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = sorted(((r.doc, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, path).collect()), key=repr)
    want = [(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in TEXTS]
    assert got == sorted(((*w, w[2] > 1024) for w in want), key=repr)
    assert token_counts.count_tokens(none, path).count() == 0


def test_token_counts_of_odd_text():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, vocab, rng = Tokenizer.from_file(path), token_counts.Vocabulary(path), random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\x1c", "\x85", "'s", "'LL", "<|endoftext|>", "é", "中", "👍", "½", "́", "aaaaaa", "the ", "12"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert vocab.count(texts) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_very_long_words():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, vocab, rng = Tokenizer.from_file(path), token_counts.Vocabulary(path), random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["a" * 3001, "ab" * 4000 + "c", "a" * 1025 + " " + "b" * 2000 + "!" * 5001 + "\u00e9" * 4000, " " * 3000 + "x",
             *("".join(rng.choices(letters, k=k)) for k in (1023, 1024, 1025, 5000, 300_000)), "".join(rng.choices("a\u00e9\u4e16b", k=20_000))]
    began = time.monotonic()
    got = vocab.count(texts)
    assert time.monotonic() - began < 20            # a round over the whole word for each rank would take minutes
    assert got == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


# ------------------------------------------------------------------ 4 chat format
TURNS = [(1, 0, "user", "hi <|im_end|>\n"), (1, 1, "user", "again \\ <\\|x"), (1, 2, "assistant", "<|im_start|>user<|im_sep|>"),
         (1, 2, "assistant", "<|im_start|>user<|im_sep|>"), (1, 3, "assistant", None), (1, 4, "assistant", "\\"), (2, None, None, None),
         (None, 0, "assistant", "x" * 100_000), (3, 0, "ro\nle<|im_sep|>", ""), (3, 0, "assistant", "é👍<")]


def test_chat_round_trip(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, formatted string"
    done = chat.format_conversations(spark.createDataFrame([(*t, "f") for t in TURNS], schema))
    got = {r.conv_id: r for r in done.withColumns({"turns": chat.read_back(F.col("formatted")),
                                                   "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))}).collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        # Spark orders escaped strings; ties of a turn are ordered by role, then text.
        assert [(t.role, t.text) for t in got[conv].turns] == [t[2:] for t in own]
        assert got[conv].loss == "".join(t[3] for t in own if t[2] == "assistant")
    assert got[1].formatted.count(chat.START) == 2 and got[1].formatted.count(chat.CONT) == 4
    assert done.filter("false").count() == 0
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


# ------------------------------------------------------------------ 5 simhash
def brute_simhash(text, k=3):
    words = (text or "").encode().translate(simhash.LOWER).split()
    shingles = [b" ".join(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(rows, bits=3):
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= bits:
            parent[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return {f: least.get(root(f)) for f in fps}


def near_texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(150)) for _ in range(6)]
    out = []
    for n in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(["omega", "psi", "chi"])
        out.append((1000 - n, " ".join(words), None))
    return out


@pytest.mark.parametrize("hot_key", [4096, 2])
def test_near_duplicates_equal_brute_force(spark, hot_key):
    rows = TEXTS + near_texts()
    got = simhash.near_duplicates(table(spark, rows), hot_key=hot_key).collect()
    own = [(i, brute_simhash(t)) for i, t, _ in rows]
    groups = brute_components(own)
    assert sorted(((r.doc, r.fp % (1 << 64), r.component) for r in got), key=repr) == sorted(((i, f, groups[f]) for i, f in own), key=repr)


def test_ring_filter_loses_no_link():
    rng, ring = random.Random(2), simhash.Ring(3, 8)
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        turns = [(x >> 8 * s | x << (64 - 8 * s)) & (1 << 64) - 1 for s in range(8)]
        chains = [all((t & ring.mask(range(n + 1))).bit_count() <= b for n, b in enumerate(ring.budgets)) for t in turns]
        keys = [any(t & ring.mask(p) == 0 for p in ring.choices) for t in turns]
        assert any(a and b for a, b in zip(chains, keys))


def test_drop_near_duplicates(spark, none):
    rows = TEXTS + near_texts()
    kept = simhash.drop_near_duplicates(table(spark, rows))
    groups = brute_components([(i, brute_simhash(t)) for i, t, _ in rows])
    assert kept.columns == none.columns
    left = Counter(groups[brute_simhash(r.text)] for r in kept.collect())
    assert left == Counter(set(groups.values()))
    assert simhash.drop_near_duplicates(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(61)}, 90: 90, 95: 90, 100: 90}


# ------------------------------------------------------------------ 6 fingerprints
def test_fingerprints_edited(spark, none):
    rows = [t for t in TEXTS if t[0] is not None]
    got = lcp.edited_likeness(table(spark, rows), rows_per_range=1).collect()
    order = sorted(rows, key=lambda r: -r[0])
    assert sorted(r.doc for r in got) == sorted(r[0] for r in rows)
    by = {r.doc: r for r in got}
    for (i, text, _), (_, following, _) in zip(order, order[1:] + order[:1]):
        if i == 1 or i == 2:
            continue                                               # id 1 repeats: its order is by text hash
        text, following = text or "", following or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        assert (by[i].n_chars, by[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (lcp.sketches([x.encode()])[0] for x in (text, edited, following))
        assert by[i].fingerprint == lcp.as_text(a) and by[i].edited_fingerprint == lcp.as_text(b)
        assert by[i].near_edited == lcp.likeness(a, b) and by[i].near_next == lcp.likeness(a, c)
    assert lcp.edited_likeness(none).count() == 0
    everything = lcp.edited_likeness(table(spark)).collect()
    assert len(everything) == len(TEXTS) and sum(r.doc is None for r in everything) == 1
    prints = {r.fingerprint for r in lcp.fingerprints(table(spark), id_col="doc_id").filter("doc = 1").collect()}
    assert len(prints) == 2


def test_equal_substrings_share_phrases():
    rng = random.Random(4)
    body = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)).encode()
    for lead in (b"", b"x", b"some other beginning "):
        a, b = lcp.sketches([body, lead + body], size=10 ** 9)
        assert len(np.intersect1d(a, b)) >= len(a) - 12
    alone = lcp.sketches([body])[0]
    assert all((s == alone).all() for s in lcp.sketches([b"zz", body, b"q" * 999, body])[1::2])


# ------------------------------------------------------------------ 7 sharding
@pytest.mark.parametrize("shards", [1, 3, 16, 50])
def test_shards_are_exact(spark, docs, shards):
    got = sharding.shuffle_into_shards(docs, shards).collect()
    sizes = Counter(r.shard for r in got)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in TEXTS)
    assert [sizes[s] for s in range(shards)] == sharding.shard_sizes(len(TEXTS), shards)
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_sharding_edges(spark, none, docs, monkeypatch):
    assert sharding.shuffle_into_shards(none, 4).count() == 0
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(docs.withColumn("Shard", F.lit(1)), 4)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    got = sharding.shuffle_into_shards(spark.range(0, 4000, 1, 5), 7, seed=1).collect()
    assert sorted(r.id for r in got) == list(range(4000))
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in enumerate(sharding.shard_sizes(4000, 7)))
    # Uniform: the mean slot of each fifth of the ids is near the middle, the shards of each fifth near equal.
    for part in range(5):
        own = [r for r in got if r.id // 800 == part]
        assert abs(np.mean([r.slot for r in own]) - 285) < 30 and max(Counter(r.shard for r in own).values()) < 160


def test_matrix_law():
    m = np.array([sharding.communication_matrix([30, 0, 70], 4, seed) for seed in range(2000)])
    assert (m.sum(axis=2) == [30, 0, 70]).all() and (m.sum(axis=1) == 25).all()
    assert abs(m[:, 0, 0].mean() - 7.5) < 0.2 and abs(m[:, 0, 0].var() - 30 * .25 * .75 * 70 / 99) < 0.5
    rng = np.random.default_rng(0)
    big = [sharding.hypergeometric(rng, 10 ** 10, 3 * 10 ** 10, 10 ** 6) for _ in range(2000)]
    assert abs(np.mean(big) - 250_000) < 60 and abs(np.std(big) / (10 ** 6 * .25 * .75) ** .5 - 1) < 0.08


# ------------------------------------------------------------------ 8 language
def test_language_identification(spark, docs, none):
    rng = random.Random(6)
    words = {"en": ["the", "house", "walking", "thing"], "de": ["die", "straße", "gehen", "schön"], "fr": ["le", "maison", "été", "chose"]}
    rows = [(100 + i, " ".join(rng.choice(words[la]) for _ in range(12)), la) for i in range(300) for la in [rng.choice("en de fr".split())]]
    got = {r.doc: r for r in langid.identify(table(spark, rows + [t for t in TEXTS if t[0] and t[0] > 1])).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(got[i].lang_pred == la for i, _, la in rows)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (2, 3, 4, 5))
    assert got[8].lang_pred in words and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.lang_pred == "und" for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert langid.identify(none).count() == 0 and langid.drop_unidentified(none).count() == 0
    kept = langid.drop_unidentified(table(spark, rows + [(1, None, "en"), (2, "...", "en")]))
    assert kept.columns == none.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows)


def test_gram_totals_equal_counting_one_by_one():
    words, times = ["été", "a", "aaaa", "👍中", "a" * 3000, "ab"], [3, 5, 1, 2, 1, 7]
    counts = Counter()
    for w, k in zip(words, times):
        for n in range(1, langid.MAX_N + 1):
            for g in langid.grams_of(w, n):
                counts[n, g] += k
    got = {(n, g): k for n, grams, totals in langid.gram_totals(words, np.array(times)) for g, k in zip(grams, totals.tolist())}
    assert got == dict(counts)
    assert all(not grams for _, grams, _ in langid.gram_totals([], np.array([], np.int64)))


def test_model_size_limits(spark):
    rows = [(i, "aa aa aa bb bb cc cc dd", "x") for i in range(4)] + [(9, "ee", "y"), (10, None, "y")]
    model = langid.train(table(spark, rows), max_words=3)
    assert model["langs"] == ["x", "y"] and set(model["tables"][0]) == {"aa", "bb", "cc", "ee"}
    assert set(langid.train(table(spark, rows), max_words=2)["tables"][0]) == {"aa", "ee"}      # bb and cc tie


def test_sample_keeps_rare_languages(spark):
    rows = [(i, "the dog runs", "en") for i in range(3000)] + [(9000 + i, "vlk beha rychle", "cs") for i in range(2)]
    model = langid.train(table(spark, rows), max_docs=40)
    assert model["langs"] == ["cs", "en"] and {"vlk", "dog"} <= model["tables"][0].keys()


def test_backoff_order():
    model = {"langs": ["a", "b"], "tables": [{"known": 0}, {"z": 0}, {}, {"zzz": 0}, {}, {}],
             "logs": [np.array([[-1, -9]], np.float32), np.array([[-9, -1]], np.float32), None, np.array([[-2, -3]], np.float32), None, None]}
    scorer = langid.Scorer(model)
    assert scorer.word("known").tolist() == [-1, -9] and scorer.word("zzz").tolist() == [-2, -3]
    assert scorer.word("z").tolist() == [-9, -1] and scorer.word("q").tolist() == [0, 0]


# ------------------------------------------------------------------ 9 packing
def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path, size=64, with_ids=True).collect()
    want = Counter()
    for i, t, _ in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = ids[k:k + 64]
            want[i, k // 64, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), tuple(part)] += 1
    assert Counter((r.doc, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 64
    assert len(by) == -(-sum(r.length for r in got) // 64)
    assert packing.pack(none, path).count() == 0
    whole = packing.packed_sequences(docs, path, size=64).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in got) and max(len(r.ids) for r in whole) <= 64


def test_stretches_equal_library():
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(1)
    tokenizer, cache = Tokenizer.from_file(path), packing.TokenCache(path)
    parts = ["a", "B", " ", "\n", "\x0b", "\x85", "'s", "'LL", "<|endoftext|>", "é", "É", "Σ", "中", "👍", "½", "́", "İ", " ", "The ", "1", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert cache.encode(texts) == want
    small = packing.TokenCache(path, room=40)          # forgets half of its words again and again
    for lo in range(0, 3000, 50):
        assert small.encode(texts[lo:lo + 50]) == want[lo:lo + 50]
    assert small.place and max(small.place.values()) == len(small.place) - 1 == len(small.start) - 2
    long = ["q" * 70 + " b", "b " + "q" * 70, "q" * 20_000]
    for _ in range(2):
        assert small.encode(long) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(long, add_special_tokens=False)]
    assert all(len(w) <= packing.CACHE_CHARS for w in small.place)


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(8)
    for _ in range(60):
        size = rng.choice([10, 20, 50])
        lengths = sorted((rng.randint(1, size) for _ in range(rng.randint(1, 9))), reverse=True)
        best = [len(lengths)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(lengths):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + lengths[i] <= size:
                    place(i + 1, bins[:j] + [bins[j] + lengths[i]] + bins[j + 1:])
            place(i + 1, bins + [lengths[i]])

        place(0, [])
        counts = np.bincount(lengths, minlength=size + 1)
        patterns = packing.complete(counts, size)
        assert sum(t for _, t in patterns) == best[0] and all(sum(p) <= size for p, _ in patterns)
        assert Counter(x for p, t in patterns for x in p * t) == Counter(lengths)
        assert packing.lower_bound(counts, size) <= best[0]


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_bin_completion_tries_fillings_of_many_pieces(k):
    counts = np.zeros(2049, np.int64)
    counts[[1000, 700, 648, 262]] = 2 * k, 2 * k, k, 8 * k
    patterns = packing.complete(counts, 2048)
    assert sum(t for _, t in patterns) == 3 * k == packing.lower_bound(counts, 2048)


def test_fillings_equal_brute_force():
    rng = random.Random(12)
    for _ in range(80):
        room, lengths = rng.randint(5, 30), [rng.randint(1, 15) for _ in range(rng.randint(1, 8))]
        every = {tuple(sorted(c, reverse=True)) for n in range(1, 9) for c in itertools.combinations(lengths, n) if sum(c) <= room}

        def dominated(f):
            rest, waste = Counter(lengths) - Counter(f), room - sum(f)
            inner = {c for n in range(1, len(f) + 1) for c in itertools.combinations(f, n)}
            return any(sum(c) <= x <= sum(c) + waste and c != (x,) for c in inner for x in rest) or any(x <= waste for x in rest)

        want = {f for f in every if not dominated(f)}
        got = [tuple(f) for f in packing.fillings(np.bincount(lengths, minlength=room + 1), room) if f]
        assert len(set(got)) == len(got) and set(got) == want
        assert [room - sum(f) for f in got] == sorted(room - sum(f) for f in got)


# ------------------------------------------------------------------ 10 WARC
PAGES = "page_id bigint, url string, html string, digest string"
BIG = "<html>" + "é body " * 300
PAGE_ROWS = [(1, "http://a/", BIG, "x"), (2, "http://b/\r\nWARC-Type: x", BIG, "x"), (5, None, BIG, "x"), (5, "u", BIG, "x"), (3, "u", "short", "x"),
             (4, "u", "short", "x"), (6, "u", None, "x"), (7, "u", "", "x"), (None, "u", BIG, "x"), (8, "u", LONG, "x")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGE_ROWS, PAGES).repartition(3)
    got = warc.round_trip(pages).collect()
    size = len(BIG.encode())
    want = Counter((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(),
                    "revisit" if i in (1, 2) else "response", 5 if i in (1, 2) else None) for i, _, h, _ in PAGE_ROWS)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.block_bytes for r in got if r.page_id in (1, 2)} == {0} and size >= 1000
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("bound", [0, warc.MAX_BROADCAST_BYTES])
def test_warc_archives_of_bounded_size_and_joined_keys(spark, tmp_path, monkeypatch, bound):
    """A small bound gives several archives, each with the dictionary, and the same records either way of the join."""
    monkeypatch.setattr(warc, "MAX_BROADCAST_BYTES", bound)
    rng = random.Random(6)
    same = "".join(rng.choices("abcd ", k=3000))
    table = [(i, f"http://h/{i}", same if i % 3 == 0 else "".join(rng.choices("abcdefgh <p>", k=rng.randint(0, 4000)))) for i in range(120)]
    pages = spark.createDataFrame(table, "page_id bigint, url string, html string").coalesce(2)
    path = str(tmp_path / "small")
    got = sorted(tuple(r) for r in warc.round_trip(pages, path=path, archive_bytes=20_000).collect())
    sizes = [f.stat().st_size for f in (tmp_path / "small").glob("part-*")]
    assert len(sizes) > 4 and max(sizes) < 100_000
    assert got == sorted(tuple(r) for r in warc.round_trip(pages).collect())
    assert [(r[0], r[3], r[4]) for r in got] == [(i, "revisit" if i % 3 == 0 and i != 117 else "response", 117 if i % 3 == 0 and i != 117 else None)
                                                 for i in range(120)]
    assert [r[1] for r in got] == [len(t[2]) for t in table]


def test_warc_archive_with_dictionary(spark, tmp_path):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "<p>", "</p>", "delta"]) + str(rng.randint(0, 99)) for _ in range(400))
    pages = spark.createDataFrame([(i, f"http://h/{i}", text(), "") for i in range(200)], PAGES).repartition(2)
    rows = warc.with_record_types(pages)
    path = str(tmp_path / "archives")
    warc.write_archives(rows, path)
    files = [f for f in (tmp_path / "archives").iterdir() if f.name.startswith("part-")]
    data = files[0].read_bytes()
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_MAGIC and size > 1000
    trained = zstandard.ZstdCompressionDict(data[8:8 + size])
    frame = data[8 + size + 8:]
    assert zstandard.ZstdDecompressor(dict_data=trained).decompressobj().decompress(frame).startswith(b"WARC/1.1\r\n")
    assert warc.read_archives(spark, path).count() == 200
    broken = bytearray(data)
    broken[-30] ^= 0xFF
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc.zst").write_bytes(bytes(broken))
    (tmp_path / "bad" / "cut.warc.zst").write_bytes(data[:-20])
    report = warc.read_archives(spark, str(tmp_path / "bad"), errors="report").collect()
    assert sum(r.error is not None for r in report) >= 2
    with pytest.raises(Exception, match="x.warc.zst|cut.warc.zst"):
        warc.read_archives(spark, str(tmp_path / "bad")).count()


@pytest.mark.parametrize("raw, why", [
    (b"WARC/1.0\r\nA: b\r\n\r\n", "version"), (b"WARC/1.1\r\nbad line\r\n\r\n", "header line"), (b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", "no WARC-Record-ID"),
    (b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Record-ID: y\r\nWARC-Date: z\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n", "Content-Length 9"),
    (b"nothing", "no end")])
def test_bad_records(raw, why):
    with pytest.raises(warc.BadRecord, match=why):
        warc.parse_record(raw)


# ------------------------------------------------------------------ clashing names
CLASHES = ["doc", "key", "spans", "Pid", "sums", "at", "draw", "pos", "bucket", "before", "place", "lang_pred", "score", "__doc", "__key",
           "__lang", "__r", "__pid", "__n", "fp", "component", "length"]


def test_clashing_columns_come_back_unchanged(spark):
    columns = ["doc_id", "text", "lang", *CLASHES]
    rows = [(i, t, la, *[f"{c} {i}" for c in CLASHES]) for i, (_, t, la) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {'bigint' if c == 'doc_id' else 'string'}" for c in columns)).repartition(3)
    bench = spark.createDataFrame([(1, TEXTS[0][1], "x")], "item_id bigint, text string, doc string")
    shards = sharding.shuffle_into_shards(df, 4)
    assert shards.columns == [*columns, "shard", "slot"]
    assert sorted(map(tuple, shards.drop("shard", "slot").collect()), key=repr) == sorted(rows, key=repr)
    for stage in (langid.drop_unidentified(df), simhash.drop_near_duplicates(df), decontaminate.decontaminate(df, bench)):
        assert stage.columns == columns
        got = set(map(tuple, stage.collect()))
        assert got and got < set(rows)
    cut = decontaminate.decontaminate(df, bench, mode="remove_spans")
    assert cut.columns == columns
    assert {r[3:] for r in map(tuple, cut.collect())} == {r[3:] for r in rows}
