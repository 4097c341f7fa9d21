"""Toxicity scores by weak supervision.

**Markers.**  Words are runs of letters, lower-cased; a term is a word's beginning of ``SHORTEST`` to ``LONGEST`` letters
or the whole word.  Over a bounded sample of labelled texts, the terms of toxic texts are counted in both classes, and
those with a large likelihood ratio become markers, no marker being the beginning of another.  Equal texts count once.

**Voters.**  Each votes toxic, clean or not at all on a text: one for each of the strongest markers, one for each built-in
list of insults, some on the number, share and variety of markers, some on patterns of writing.

**Label model.**  The votes of all texts that are not held out, as counts of equal vote patterns, fit a generative model
P(y) P(v_1 | y) product of P(v_j | v_parent(j), y) by expectation maximisation: a voter's accuracy is its table, and the
correlations of voters are a tree, the heaviest by mutual information given y, so that voters who repeat each other
count once.  Known labels hold with probability ``TRUST``; without any, the votes' majority starts the estimate.

**Classifier.**  The model's posterior labels of a bounded sample train a logistic regression on counts of markers and
their number, share and variety.  Its probability is the score.

Bounds (all parameters): ``MAX_LABELLED`` rows of each class for the markers and ``MAX_TRAINED`` rows for the classifier,
both chosen by a hash of the id, ``MAX_TERMS`` terms of toxic texts, ``MAX_MARKERS`` markers, ``MAX_VOTERS`` marker voters.
The votes and scores are those of every text.

Defined results: a null, empty or wordless text has no marker and gets the score of such a text; labels count where the
id's crc32 modulo 4 is not 2, an id with several labels is toxic if one of them says so, and null ids or labels are none;
an empty label table leaves the built-in lists and patterns; a null id is not held out; repeated rows each get their
row; an empty table gives none; only the named columns are read.  Whole texts are counted, however long.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tambo.llm.common import checkpointed, like_type
from tambo.llm.langid import held_out

MAX_LABELLED, MAX_TRAINED = 20_000, 20_000
MAX_TERMS, MAX_MARKERS, MAX_VOTERS = 50_000, 200, 24
SHORTEST, LONGEST = 3, 8
#: Least texts with a term, likelihood ratio (G2) and ratio of frequencies of a marker.
LEAST_TEXTS, LEAST_G2, LEAST_RATIO = 3, 20.0, 4.0
#: Probability of a known label, rounds of estimation, weight of the uniform prior of each vote table.
TRUST, ROUNDS, PRIOR = 0.98, 4, 1.0
#: Words looked up and remembered by a worker.
CACHE = 400_000
WORD = re.compile(r"[^\W\d_]+")

# Common insults.
INSULTS = {
    "en": "idiot moron stupid trash loser scum clown worthless pathetic disgusting imbecile dumbass bastard bitch asshole "
          "retard creep vermin",
    "de": "idiot dumm trottel abschaum arschloch wichser schlampe hurensohn widerlich erbärmlich missgeburt",
    "fr": "idiot idiote imbécile crétin connard connasse salope ordure minable dégueulasse abruti",
    "es": "idiota imbécil estúpido estúpida basura escoria cabrón gilipollas payaso asqueroso patético inútil",
}
SHOUT, MASKED = re.compile(r"\b[A-Z]{4,}\b"), re.compile(r"\b[^\W\d_][*#@$%]{2,}[^\W\d_]")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def terms_of(word: str) -> list[str]:
    """Beginnings of a word and, marked by its end, the word."""
    return [word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word + "$"]


# ------------------------------------------------------------------ markers
def _term_counts(known: frozenset[str] | None):
    """mapInArrow function over (text): in how many texts each term, or each known one, occurs; for "", the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter({"": batch.num_rows})
            for text in batch.column(0).to_pylist():
                terms = {t for w in set(words_of(text)) for t in terms_of(w)}
                counts.update(terms if known is None else terms & known)
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])
    return run


def likelihood_ratio(n1: int, all1: int, n0: int, all0: int) -> float:
    """G2 of a term's presence against the class."""
    total, g = all1 + all0, 0.0
    for n, size in ((n1, all1), (n0, all0)):
        for seen, share in ((n, (n1 + n0) / total), (size - n, 1 - (n1 + n0) / total)):
            if seen:
                g += 2 * seen * math.log(seen / (size * share))
    return g


def choose_markers(counts: dict[str, tuple[int, int]], all1: int, all0: int, most: int = MAX_MARKERS) -> list[str]:
    """Strongest terms first; of terms that begin alike only the strongest, the longer of equals."""
    scored = []
    for term, (n1, n0) in counts.items():
        ratio = (n1 + 0.5) / (all1 + 1) / ((n0 + 0.5) / (all0 + 1))
        if ratio >= LEAST_RATIO and (g := likelihood_ratio(n1, all1, n0, all0)) >= LEAST_G2:
            scored.append((-round(g, 6), -len(term), term))
    chosen: list[str] = []
    begun: set[str] = set()     # all beginnings of the chosen
    for _, _, term in sorted(scored):
        if len(chosen) == most:
            break
        heads = {term[:n] for n in range(1, len(term) + 1)}
        if term not in begun and not heads & set(chosen):
            chosen.append(term)
            begun |= heads
    return chosen


def learn_markers(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[str]:
    """Markers from (doc, text) and (doc, toxic), whose labels may all be used."""
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}     # two rows
    if not sizes.get(0) or not sizes.get(1):
        return []
    share = F.pmod(F.xxhash64("doc"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    texts = {}
    for toxic in (1, 0):
        ids = labels.filter((F.col("toxic") == toxic) & (share < max_labelled / sizes[toxic])).select("doc")     # about max_labelled rows
        own = docs.join(F.broadcast(ids), "doc").filter("text is not null")
        # A text that was copied many times says no more than once what words are toxic.
        texts[toxic] = own.groupBy(F.xxhash64("text")).agg(F.first("text").alias("text")).select("text")
    terms = texts[1].mapInArrow(_term_counts(None), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    often = terms.filter((F.col("n") >= LEAST_TEXTS) | (F.col("term") == "")).orderBy(F.desc("n"), "term").limit(MAX_TERMS)
    toxic = {r["term"]: r["n"] for r in often.collect()}
    clean = texts[0].mapInArrow(_term_counts(frozenset(toxic)), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    clean = {r["term"]: r["n"] for r in clean.collect()}       # of the same terms
    all1, all0 = toxic.pop("", 0), clean.pop("", 0)
    return choose_markers({t: (n, clean.get(t, 0)) for t, n in toxic.items()}, all1, all0)


# ------------------------------------------------------------------ votes and features of a text
@dataclass
class Reader:
    """What a text shows: marker counts, list hits, patterns; and how the voters vote on it."""

    markers: list[str]
    place: dict[str, int] = field(init=False)
    cache: dict[str, int] = field(init=False, default_factory=dict)

    def __post_init__(self):
        self.place = {m: i for i, m in enumerate(self.markers)}
        self.lists = [frozenset(x.split()) for x in INSULTS.values()]
        self.listed = frozenset().union(*self.lists)
        self.own = min(len(self.markers), MAX_VOTERS)
        self.names = self.markers[:self.own] + [f"list {x}" for x in INSULTS] + [
            "several", "share", "variety", "listed several", "shouting", "exclaiming", "masked"]

    def marker(self, word: str) -> int:
        """Place of the word's marker, the number of markers for other listed insults, -1 for any other word."""
        at = self.cache.get(word)
        if at is None:
            at = next((self.place[t] for t in terms_of(word) if t in self.place), len(self.markers) if word in self.listed else -1)
            if len(self.cache) < CACHE:
                self.cache[word] = at
        return at

    def read(self, text: str | None) -> tuple[int, list[int], list[int], int, int]:
        """(words, places of markers, their counts, mask of votes for toxic, mask of votes for clean)."""
        found = Counter(words_of(text))
        n, hits, listed = sum(found.values()), Counter(), []
        for word, count in found.items():
            at = self.marker(word)
            if at >= 0:
                hits[at] += count
                if word in self.listed:
                    listed.append((word, count))
        total, kinds = sum(hits.values()), len(hits)
        votes = [1 if j in hits else 0 for j in range(self.own)]
        votes += [1 if any(w in x for w, _ in listed) else 0 for x in self.lists]
        votes.append(1 if total >= 2 else 0 if total else -1)
        votes.append(1 if total >= 2 and 100 * total >= n else -1 if 300 * total < n or not n else 0)
        votes.append(1 if kinds >= 2 else 0)
        votes.append(1 if sum(c for _, c in listed) >= 2 else 0)
        votes.append(1 if text and sum(1 for _ in SHOUT.finditer(text)) >= 3 else 0)
        votes.append(1 if text and "!!" in text else 0)
        votes.append(1 if text and MASKED.search(text) else 0)
        plus = sum(1 << j for j, v in enumerate(votes) if v > 0)
        minus = sum(1 << j for j, v in enumerate(votes) if v < 0)
        return n, list(hits), list(hits.values()), plus, minus


def features(n: np.ndarray, places: list, counts: list, markers: int) -> np.ndarray:
    """Rows of the classifier: logarithms of counts of markers (the last for other insults) and sums over them."""
    out = np.zeros((len(n), markers + 6))
    lengths = np.fromiter(map(len, places), np.int64, len(places))
    at = np.repeat(np.arange(len(n)), lengths)
    count = np.array([c for cs in counts for c in cs], np.float64)
    out[at, np.array([p for ps in places for p in ps], np.int64)] = np.log1p(count)
    total = np.bincount(at, weights=count, minlength=len(n))
    out[:, markers + 1] = np.log1p(total)
    out[:, markers + 2] = total >= 2
    out[:, markers + 3] = lengths >= 2
    out[:, markers + 4] = np.minimum(100 * total / np.maximum(n, 1), 2)
    out[:, markers + 5] = 1
    return out


def read_texts(docs: DataFrame, markers: list[str]) -> DataFrame:
    """(doc, n, places, counts, plus, minus) of (doc, text)."""
    held = docs.sparkSession.sparkContext.broadcast(Reader(markers))      # a worker's copy keeps the words it has looked up

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, places, counts, plus, minus = zip(*map(reader.read, part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64())),
                     pa.array(plus, pa.int64()), pa.array(minus, pa.int64())], ["doc", "n", "places", "counts", "plus", "minus"])

    kind = like_type(docs, "doc")
    return docs.select("doc", "text").mapInArrow(run, f"doc {kind}, n bigint, places array<int>, counts array<bigint>, plus bigint, minus bigint")


# ------------------------------------------------------------------ label model
def states(plus: np.ndarray, minus: np.ndarray, voters: int) -> np.ndarray:
    """Votes as 0 (clean), 1 (none), 2 (toxic), a column for each voter."""
    bits = np.arange(voters)
    return 1 + ((plus[:, None] >> bits) & 1) - ((minus[:, None] >> bits) & 1)


@dataclass
class LabelModel:
    """Prior of toxic and, for each voter but the first in order, its table given class and its parent's vote."""

    prior: float
    order: list[tuple[int, int]]        # (voter, parent; -1 for the first)
    tables: list[np.ndarray]            # class x parent's vote x own vote, logarithms

    @staticmethod
    def fit(sums: np.ndarray) -> LabelModel:
        """From ``sums``, class x 3V x 3V: weights of texts with a pair of votes (on the diagonal: of single votes)."""
        voters = sums.shape[1] // 3
        cells = sums.reshape(2, voters, 3, voters, 3).transpose(0, 1, 3, 2, 4) + PRIOR / 9
        size = np.array([np.trace(sums[z, :3, :3]) for z in (0, 1)])
        joint = cells / cells.sum(axis=(3, 4), keepdims=True)                   # class, j, k, vote of j, vote of k
        apart = joint.sum(axis=4, keepdims=True) * joint.sum(axis=3, keepdims=True)
        share = (size + 1) / (size + 1).sum()
        shared = np.einsum("z,zjk->jk", share, (joint * np.log(joint / apart)).sum(axis=(3, 4)))
        # The heaviest tree, grown from voter 0.
        parent, weight, order, left = np.zeros(voters, int), shared[0].copy(), [(0, -1)], set(range(1, voters))
        while left:
            j = max(left, key=lambda x: (weight[x], -x))
            left.remove(j)
            order.append((j, int(parent[j])))
            closer = shared[j] > weight
            parent[closer], weight = j, np.maximum(weight, shared[j])
        single = np.stack([[np.diag(sums[z, 3 * j:3 * j + 3, 3 * j:3 * j + 3]) + PRIOR / 3 for j in range(voters)] for z in (0, 1)])
        tables = []
        for j, p in order:
            table = np.repeat(single[:, j][:, None, :], 3, axis=1) if p < 0 else cells[:, p, j]
            tables.append(np.log(table / table.sum(axis=2, keepdims=True)))
        return LabelModel(float(share[1]), order, tables)

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Probability of toxic given votes (states) and label (0, 1, or -1 for none)."""
        odds = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        for (j, p), table in zip(self.order, self.tables):
            before = votes[:, p] if p >= 0 else 0
            odds += table[1, before, votes[:, j]] - table[0, before, votes[:, j]]
        odds += np.where(label < 0, 0.0, np.where(label == 1, 1.0, -1.0)) * math.log(TRUST / (1 - TRUST))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracies(self, sums: np.ndarray, names: list[str]) -> dict[str, float]:
        """Share of each voter's votes that agree with the class; null where it never voted."""
        out = {}
        for j, name in enumerate(names):
            clean, toxic = np.diag(sums[0])[3 * j:3 * j + 3], np.diag(sums[1])[3 * j:3 * j + 3]
            voted = clean[0] + clean[2] + toxic[0] + toxic[2]
            out[name] = float((clean[0] + toxic[2]) / voted) if voted else float("nan")
        return out


def _weigh(model: LabelModel | None, voters: int, labelled: bool):
    """mapInArrow function over (plus, minus, label, count): sums of pair weights by class, one row for each cell.

    Without a model, known labels alone count, or, where there are none, the votes' majority.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 3 * voters, 3 * voters))
        for batch in batches:
            plus, minus, label, count = (batch.column(i).to_numpy() for i in range(4))
            votes = states(plus, minus, voters)
            if model is not None:
                toxic = model.posterior(votes, label)
            elif labelled:
                toxic, count = np.where(label == 1, TRUST, 1 - TRUST), count * (label >= 0)
            else:
                toxic = 1 / (1 + np.exp(2.0 - (votes - 1).sum(axis=1)))
            one_hot = np.zeros((len(votes), 3 * voters))
            one_hot[np.arange(len(votes))[:, None], 3 * np.arange(voters) + votes] = 1
            for z, weight in ((0, count * (1 - toxic)), (1, count * toxic)):
                total[z] += one_hot.T @ (one_hot * weight[:, None])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["cell", "weight"])
    return run


def label_model(patterns: DataFrame, voters: int, rounds: int = ROUNDS) -> tuple[LabelModel, np.ndarray]:
    """The model fitted to (plus, minus, label, count) and the sums of its last round (class x 3V x 3V, on the driver)."""
    known = {r["label"] for r in patterns.filter("label >= 0").select("label").distinct().collect()}
    model = None
    for _ in range(rounds + 1):
        found = patterns.mapInArrow(_weigh(model, voters, len(known) == 2), "cell int, weight double")
        sums = np.zeros(2 * 9 * voters * voters)
        for cell, weight in found.groupBy("cell").agg(F.sum("weight").alias("weight")).collect():     # 18 V squared at most
            sums[cell] = weight
        sums = sums.reshape(2, 3 * voters, 3 * voters)
        model = LabelModel.fit(sums)
    return model, sums


# ------------------------------------------------------------------ classifier
def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft targets (Newton's method, the constant in the last column unpunished)."""
    w = np.zeros(x.shape[1])
    punish = np.full(x.shape[1], ridge)
    punish[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(punish), x.T @ (target - p) - punish * w)
        w += step * min(1.0, 10 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
                   label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_trained: int = MAX_TRAINED) -> DataFrame:
    """(doc, held_out, score) per row."""
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    known = labels.select(F.col(label_id).alias("doc"), F.col(label_col).cast("int").alias("toxic")).filter(
        F.col("doc").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc")))
    known = known.groupBy("doc").agg(F.max("toxic").alias("toxic"))
    markers = learn_markers(base, known, max_labelled)
    voters = len(Reader(markers).names)
    rows = checkpointed(read_texts(base, markers))
    learned = rows.filter(~held_out(F.col("doc"))).join(known, "doc", "left").select(
        "doc", "n", "places", "counts", "plus", "minus", F.coalesce("toxic", F.lit(-1)).alias("label"))
    patterns = checkpointed(learned.groupBy("plus", "minus", "label").count())
    size = patterns.agg(F.sum("count")).first()[0] or 0
    if not size:
        weights = np.zeros(len(markers) + 6)
    else:
        model, _ = label_model(patterns, voters)
        share = F.pmod(F.xxhash64("doc", "n", "plus"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        part = learned.filter(share < max_trained / size) if size > max_trained else learned
        part = part.drop("doc").toArrow().to_pydict()       # about max_trained rows of counts
        votes = states(np.array(part["plus"], np.int64), np.array(part["minus"], np.int64), voters)
        x = features(np.array(part["n"], np.int64), part["places"], part["counts"], len(markers))
        weights = logistic(x, model.posterior(votes, np.array(part["label"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), len(markers))
            scores = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc", "score"])

    scored = rows.select("doc", "n", "places", "counts").mapInArrow(run, f"doc {like_type(base, 'doc')}, score double")
    return scored.select("doc", held_out(F.col("doc")).alias("held_out"), "score")
