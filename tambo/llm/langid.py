"""Language identification: known words first, then ever shorter character n-grams.

Training counts words per language over labelled texts.  The model keeps each
language's commonest words, about ``max_words``, and, for every n from
``MAX_N`` down to 1, its commonest character n-grams, about ``max_grams``
(words wrapped in ``<`` and ``>``, grams weighted by word counts); of the items with
the count at which the number is reached, the share that still fits is kept, by a
hash of the item.  A text's score for a language is a sum
over its words: a word known to any language gives its smoothed log frequency;
an unknown word backs off to the longest n of which it holds a known n-gram, and
gives the mean log frequency of its known n-grams.

Training may be limited to a sample of about ``max_docs`` labelled rows (fewer
where some of them have no text), an equal number of each language, chosen by a
hash of the id, and all rows of languages that have fewer; the vocabulary counts are Spark aggregates, and only the
model, bounded by its parameters, reaches the driver.

Defined results: a text that is null or has no letter gets ``und`` and score 0;
otherwise the best language (ties: the first by name) with its posterior
probability, in proportion to the number of words up to ``EVIDENCE`` of them;
without any labelled text all are ``und``; repeated rows each get a row; only
the named columns are read, and of those only the text by prediction.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tambo.llm.common import checkpointed, like_type, own_names

UNKNOWN = "und"
MAX_N = 5
MAX_DOCS, MAX_WORDS, MAX_GRAMS = 20_000, 20_000, 8_000
#: Score entries (words x languages) remembered per worker.
CACHE_CELLS = 1_600_000
#: Words beyond which more text does not sharpen the posterior.
EVIDENCE = 20
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


# ------------------------------------------------------------------ training
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(words_of(text))
        for lang, found in counts.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()),
                pa.array(list(found.values()), pa.int64())], ["lang", "item", "n"])


def gram_totals(words: list[str], times: np.ndarray) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(n, grams, counts) of all words at once, for every n up to ``MAX_N``; a word counts ``times``.

    An n-gram is numbered by the number of its first n - 1 characters and its last character.
    """
    padded = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(padded.encode("utf-32-le"), np.uint32)
    alphabet, codes = np.unique(codes, return_inverse=True)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    weight = np.repeat(times, lengths)
    at, number = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    for n in range(1, MAX_N + 1):
        inside = left[at] >= n
        at, number = at[inside], number[inside]
        _, first, number = np.unique(number * len(alphabet) + codes[at + n - 1], return_index=True, return_inverse=True)
        totals = np.bincount(number, weights=weight[at], minlength=len(first)).astype(np.int64)
        yield n, [padded[i:i + n] for i in at[first].tolist()], totals


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        words = np.array(batch.column(1).to_pylist(), object)
        times = batch.column(2).to_numpy()
        for lang in sorted(set(langs)):
            own = langs == lang
            for n, grams, totals in gram_totals(words[own].tolist(), times[own]):
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(grams), pa.string()), pa.array([n] * len(grams), pa.int32()),
                    pa.array(grams, pa.string()), pa.array(totals)], ["lang", "kind", "item", "n"])


def train(labelled: DataFrame, max_docs: int | None = MAX_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Model over rows whose text and language are not null: {kind: {item: log frequencies by language}}."""
    rows = labelled.select(F.col(id_col).alias("doc"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter("lang is not null")
    if max_docs is not None:
        sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))     # reads no text; one row a language
        found = sizes.agg(F.sum("rows").alias("rows"), F.count("*").alias("langs")).first()
        if (found["rows"] or 0) > max_docs:
            share = F.pmod(F.xxhash64("doc"), F.lit(1 << 40)) / F.lit(float(1 << 40))
            rows = rows.join(F.broadcast(sizes), "lang").filter(share < max_docs / found["langs"] / F.col("rows")).drop("rows")
    words = rows.filter("text is not null").select("lang", "text").mapInArrow(_word_counts, "lang string, item string, n bigint")
    words = checkpointed(words.groupBy("lang", "item").agg(F.sum("n").alias("n")))
    grams = words.mapInArrow(_gram_counts, "lang string, kind int, item string, n bigint")
    counts = checkpointed(words.select("lang", F.lit(0).alias("kind"), "item", "n").union(
        grams.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))))
    # The least count kept whole and the share kept of the count below, from how many items have each count: no window
    # over the vocabulary.
    sizes = counts.groupBy("lang", "kind", "n").agg(F.count("*").alias("items"))
    by_kind = Window.partitionBy("lang", "kind")
    sizes = sizes.withColumn("above", F.sum("items").over(by_kind.orderBy(F.desc("n"))))
    room = F.when(F.col("kind") == 0, max_words).otherwise(max_grams)
    over = F.when(F.col("above") > room, F.col("n"))
    least = sizes.groupBy("lang", "kind").agg(
        F.coalesce(F.min(F.when(F.col("above") <= room, F.col("n"))), F.max("n") + 1).alias("least"), F.max(over).alias("partly"),
        F.max_by((room - F.col("above") + F.col("items")) / F.col("items"), over).alias("share"),
        F.sum(F.col("n") * F.col("items")).alias("total"))
    place_of = F.pmod(F.xxhash64("item"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    best = counts.join(F.broadcast(least), ["lang", "kind"])      # six rows a language
    best = best.filter((F.col("n") >= F.col("least")) | ((F.col("n") == F.col("partly")) & (place_of < F.col("share"))))
    kept = best.select("lang", "kind", "item", "n", "total").toArrow().to_pydict()
    langs = sorted(set(kept["lang"]))
    place = {lang: i for i, lang in enumerate(langs)}
    model: dict = {"langs": langs, "tables": [{} for _ in range(MAX_N + 1)]}
    found = [np.zeros((0, 0))] * (MAX_N + 1)
    sums = np.ones((MAX_N + 1, len(langs)))
    for lang, kind, item, n, total_n in zip(*kept.values()):
        model["tables"][kind].setdefault(item, len(model["tables"][kind]))
        sums[kind, place[lang]] = total_n
    for kind, table in enumerate(model["tables"]):
        found[kind] = np.zeros((len(table), len(langs)))
    for lang, kind, item, n, _ in zip(*kept.values()):
        found[kind][model["tables"][kind][item], place[lang]] = n
    # One floor for all languages, half a count of the largest, so that little training text is no advantage.
    model["logs"] = [np.log(f / sums[k] + 0.5 / sums[k].max(initial=1.0)).astype(np.float32) for k, f in enumerate(found)]
    return model


# ------------------------------------------------------------------ prediction
class Scorer:
    def __init__(self, model: dict):
        self.langs, self.tables, self.logs = model["langs"], model["tables"], model["logs"]
        self.room = max(CACHE_CELLS // max(len(self.langs), 1), 1024)
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.langs)), np.float32)

    def word(self, word: str) -> np.ndarray:
        """Log frequencies of one word, by backoff; zeros when no n-gram of it is known."""
        at = self.tables[0].get(word)
        if at is not None:
            return self.logs[0][at]
        for n in range(MAX_N, 0, -1):
            table = self.tables[n]
            known = [table[g] for g in grams_of(word, n) if g in table]
            if known:
                return self.logs[n][known].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def learn(self, words: set[str]) -> None:
        if len(self.rows) + len(words) > self.room:
            self.rows = {}
        new = words - self.rows.keys()
        need = len(self.rows) + len(new)
        if need > len(self.scores):
            grown = np.zeros((max(need, 2 * len(self.scores)), len(self.langs)), np.float32)
            grown[:len(self.rows)] = self.scores[:len(self.rows)]
            self.scores = grown
        for w in new:
            self.scores[len(self.rows)] = self.word(w)
            self.rows[w] = len(self.rows)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [words_of(t) if t else [] for t in texts]
        words = [ws if any(c.isalpha() for w in ws for c in w) else [] for ws in words]
        self.learn(set().union(*words))
        langs, scores = [], []
        for ws in words:
            if not ws or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            at = np.fromiter(map(self.rows.__getitem__, ws), np.int64, len(ws))
            total = self.scores[at].sum(axis=0, dtype=np.float64) * (min(len(ws), EVIDENCE) / len(ws))
            best = int(total.argmax())
            langs.append(self.langs[best])
            scores.append(1.0 / sum(math.exp(x - total[best]) for x in total))
        return langs, scores


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc, lang_pred, score) per row, or the columns ``keep`` and the two (``own_names``) for language and score."""
    # Each worker's copy of the scorer keeps the words it has looked up from task to task.
    held = docs.sparkSession.sparkContext.broadcast(Scorer(model))
    rows = docs.select(*[f"`{c}`" for c in keep]) if keep else docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("__text"))
    text_at = keep.index(text_col) if keep else 1
    names = keep or ["doc"]
    lang, score = own_names(rows, "lang_pred", "score") if keep else ("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                langs, scores = scorer.predict(part.column(text_at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 [*names, lang, score])

    schema = ", ".join(f"`{n}` {like_type(rows, n)}" for n in names)
    return rows.mapInArrow(run, f"{schema}, {lang} string, {score} double")


def held_out(doc_id, remainder: int = 2):
    """Whether crc32 of the id as text leaves ``remainder`` modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == remainder, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **sizes) -> DataFrame:
    """(doc, held_out, lang_pred, score) per row; learned from the rows that are not held out."""
    model = train(docs.filter(~held_out(F.col(id_col)) & F.col(id_col).isNotNull()), id_col=id_col, text_col=text_col,
                  lang_col=lang_col, **sizes)
    return predict(docs, model, id_col, text_col).withColumn("held_out", held_out(F.col("doc")))


def drop_unidentified(docs: DataFrame, min_score: float = 0.0, languages: list[str] | None = None, id_col: str = "doc_id",
                      text_col: str = "text", lang_col: str = "lang", **sizes) -> DataFrame:
    """The documents, with their own columns, whose text has a language (not ``und``; one of ``languages``, by default any that
    was learned) with a score of at least ``min_score``."""
    model = train(docs.filter(~held_out(F.col(id_col)) & F.col(id_col).isNotNull()), id_col=id_col, text_col=text_col,
                  lang_col=lang_col, **sizes)
    judged = predict(docs, model, id_col, text_col, keep=docs.columns)
    lang, score = own_names(docs, "lang_pred", "score")
    wanted = F.col(lang) != UNKNOWN if languages is None else F.col(lang).isin(languages)
    return judged.filter(wanted & (F.col(score) >= min_score)).drop(lang, score)
