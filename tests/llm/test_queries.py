"""The registered queries against their SQL, and the pipeline against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from tambo.llm import langid
from tambo.llm.queries import ORACLE, QUERIES

from conftest import SF_SMALL
from test_operators import brute_components, brute_contamination, brute_simhash


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    rel = con.sql(ORACLE[name])
    got = QUERIES[name](spark, SF_SMALL).select(*rel.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def brute_languages(rows, max_words=langid.MAX_WORDS, max_grams=langid.MAX_GRAMS):
    """{id: (language, score)} by the definition, one word at a time."""
    word = re.compile(r"[^\W\d_]+")
    grams = lambda w, n: [f"<{w}>"[i:i + n] for i in range(len(w) + 3 - n)]                     # noqa: E731
    counts = defaultdict(Counter)       # (kind, language) -> item counts; kind 0: words
    for i, text, lang in rows:
        if lang is not None and text and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[0, lang].update(word.findall(text.lower()))
    langs = sorted(lang for _, lang in counts)
    for lang in langs:
        for w, c in counts[0, lang].items():
            for n in range(1, 6):
                for g in grams(w, n):
                    counts[n, lang][g] += c
    assert all(len(c) <= (max_grams if kind else max_words) for (kind, _), c in counts.items())     # the bounds are tested below
    sums = {k: sum(c.values()) for k, c in counts.items()}
    known = {kind: set().union(*(counts[kind, lang] for lang in langs)) for kind in range(6)}
    log = lambda kind, item, lang: math.log(counts[kind, lang][item] / sums[kind, lang]         # noqa: E731
                                            + 0.5 / max(sums[kind, la] for la in langs))
    out = {}
    for i, text, _ in rows:
        words = word.findall((text or "").lower())
        total = dict.fromkeys(langs, 0.0)
        for w in words:
            kind, items = 0, [w]
            while kind == 0 and w not in known[0]:
                kind, items = next(((n, [g for g in grams(w, n) if g in known[n]]) for n in range(5, 0, -1)
                                    if any(g in known[n] for g in grams(w, n))), (-1, []))
            for lang in langs if items else []:
                total[lang] += sum(log(kind, x, lang) for x in items) / len(items)
        scale = min(len(words), langid.EVIDENCE) / max(len(words), 1)
        best = max(langs, key=lambda la: (total[la], -langs.index(la)))
        out[i] = (best, 1 / sum(math.exp((total[la] - total[best]) * scale) for la in langs)) if words else ("und", 0.0)
    return out


def test_language_scores_equal_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    short = [(i, (t or "")[:300], la) for i, t, la in rows]
    want = brute_languages(short, 10**9, 10**9)
    df = spark.createDataFrame(short, "doc_id bigint, text string, lang string").repartition(3)
    got = {r.doc: r for r in langid.identify(df, max_words=10**9, max_grams=10**9).collect()}
    assert len(got) == len(want)
    for i, (lang, score) in want.items():
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-3, (i, got[i], lang, score)


def test_vocabulary_bound_keeps_a_share_of_equal_counts(spark):
    rows = [(i, " ".join(f"w{'abcdefghij'[j % 10]}{'klmnopqrst'[j // 10 % 10]}{'uvwxyzabcd'[j // 100]}q" for j in range(i * 100, i * 100 + 100)), "aa")
            for i in range(10)] + [(100 + i, "zu " * 5 + "der die das", "bb") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(df, max_words=400, max_grams=400)
    kept = [w for w in model["tables"][0] if w.startswith("w")]
    assert 300 < len(kept) < 500 and {"zu", "der", "die", "das"} <= set(model["tables"][0])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_gives_a_row_for_every_document(spark, name):
    """The registered queries without SQL, whose operators are compared with brute force elsewhere."""
    rows = QUERIES[name](spark, SF_SMALL).select("doc_id").collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id").collect()]
    assert sorted({r.doc_id for r in rows}) == sorted(ids)
    assert name == "op9_best_fit_packing" or len(rows) == len(ids)


def test_stage_contracts(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns
        kept = {r.doc_id for r in after.collect()}
        if name == "language_id":
            scored = {r.doc: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}     # compared with brute force above
            assert kept == {i for i, (lang, score) in scored.items() if lang != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE}
            assert kept < {r.doc_id for r in before}
        elif name == "near_dedup":
            own = [(r.doc_id, brute_simhash(r.text)) for r in before]
            groups = brute_components(own)
            assert kept == {groups[f] for _, f in own}
        else:
            bad = {r[0] for r in brute_contamination([(r.doc_id, r.text) for r in before], bench) if r[4]}
            assert kept == {r.doc_id for r in before} - bad and bad
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, SF_SMALL).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)      # noqa: E731
    assert sorted(map(key, whole)) == sorted(map(key, packed))
