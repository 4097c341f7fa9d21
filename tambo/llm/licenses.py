"""License scan: winnowed fingerprints find candidate templates, banded alignment measures them.

Words are lower-cased runs of digits, letters and non-ASCII characters.  Of
every ``window`` consecutive ``k``-word hashes the smallest is kept (winnowing), so
a run of ``k + window - 1`` words shared by text and template always shares a
fingerprint.  Of templates of at most ``SHORT`` words every hash is kept, as they may
be shorter than that run; a template needs ``k`` words to be found in a text.  The templates' fingerprints form an inverted index (hash ->
template and place), whose size depends on the templates alone.  Hits of a
template are collected by diagonal (place in the text less place in the
template) in buckets one band (an eighth of the template) wide; three
neighbouring buckets that hold ``min_share`` of the template's fingerprints are a
candidate, however often the template repeats a phrase, and are aligned with one
more band on both sides (match +2, mismatch and gap -1, best local path).  So
words put in or left out may shift a copy by a quarter of the template.
A match covers matched words / template words of at least ``min_coverage``.

Of a template of at most ``SHORT`` words all words that tell licenses apart
(``NAMES``, and words with a digit) must match, no word of ``VARIANTS`` may stand
between the matched ones, and a matched number may not be part of another
version (2 in 2.1; 3.0 is 3).

Matches of one template do not overlap.  Where different templates match the same
words (a notice inside a longer text, licenses of like wording), the match of
most words, then of fewest gaps, counts, and one that shares half of its words
with such matches is listed under ``lesser`` only.  All of a text is scanned, and nothing is shuffled.

Defined results: null or empty texts have no match; templates without words are
passed over; repeated rows each get a row; an empty table gives no rows; only
the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tambo.llm.common import like_type
from tambo.llm.license_texts import NAMES, TEMPLATES, VARIANTS
from tambo.llm.wordhash import U, finish, words

K, WINDOW = 3, 3
MIN_SHARE, MIN_COVERAGE = 0.25, 0.8
#: Templates of at most so many words are looked up by every run of ``K`` words, in text and template.
SHORT = 40
#: Buckets of diagonals, one band wide, that are searched together.
BUCKETS = 3
SAME, OTHER, UP, LEFT = 1, 2, 3, 4
#: Bytes of text hashed at a time, about (a longer text is hashed whole): bounds memory.
BLOCK_BYTES = 1 << 20
MATCH = ("template: string, coverage: double, matched_words: int, start_word: int, end_word: int, start_char: int, "
         "end_char: int")


def grams(hashes: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``k`` words of one text; a shorter text is one run."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, U)
    with np.errstate(over="ignore"):
        total = np.zeros(n, U)
        for j in range(k):
            step = U((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            total[:n - j] += finish(hashes[j:] * step)
        whole = np.zeros(n, bool)
        if n >= k:
            whole[:n - k + 1] = text[:n - k + 1] == text[k - 1:]
        heads = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        short = heads[np.diff(heads, append=n) < k]
        for h in short.tolist():
            end = h + int((text[h:h + k] == text[h]).sum())
            total[h] = sum((finish(hashes[j:j + 1] * U((2 * (j - h) + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))[0]
                            for j in range(h, end)), U(0))
    whole[short] = True
    at = np.flatnonzero(whole)
    return at, finish(total[at])


def winnow(gram: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Places in ``gram`` that are smallest (the last of equal ones) of some ``window`` neighbours of their text; texts
    with fewer keep all."""
    n = len(gram)
    keep = np.zeros(n, bool)
    if n == 0:
        return np.empty(0, np.int64)
    heads = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    count = np.diff(heads, append=n)
    keep |= np.repeat(count < window, count)
    if n >= window:
        stack = np.stack([gram[window - 1 - j:n - j] for j in range(window)])      # last place first
        best = np.arange(n - window + 1) + window - 1 - stack.argmin(axis=0)
        keep[best[text[:n - window + 1] == text[window - 1:]]] = True
    return np.flatnonzero(keep)


class Index:
    """The templates' words and their inverted index."""

    def __init__(self, templates: list[tuple[str, str]], k: int = K, window: int = WINDOW):
        self.k, self.window = k, window
        self.names, self.words, self.prints, self.telling = [], [], [], []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for name, text in templates:
            starts, ends, hashes, owner = words([text.encode()])
            if not len(hashes):
                continue
            at, gram = grams(hashes, owner, k)
            kept = np.arange(len(gram)) if len(hashes) <= SHORT else winnow(gram, owner[at], window)
            found.append((gram[kept], np.full(len(kept), len(self.names)), at[kept]))
            self.names.append(name)
            self.words.append(hashes)
            own = [text.encode()[a:b].decode().lower() for a, b in zip(starts.tolist(), ends.tolist())]
            tells = [len(own) <= SHORT and (w in NAMES or any(c.isdigit() for c in w)) for w in own]
            self.telling.append(np.flatnonzero(tells))
            self.prints.append(len(kept))
        self.short = np.array([len(w) <= SHORT for w in self.words], bool)
        gram, template, place = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, U), *[np.empty(0, np.int64)] * 2)
        order = np.lexsort((place, template, gram))
        self.template, self.place = template[order], place[order]
        self.hashes, first = np.unique(gram[order], return_index=True)
        self.first = np.append(first, len(order))

    def hits(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``gram`` that the index holds, with each template and word of it that has the same hash."""
        if not len(self.hashes) or not len(gram):
            return (np.empty(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.hashes, gram), len(self.hashes) - 1)
        found = np.flatnonzero(self.hashes[at] == gram)
        at = at[found]
        times = self.first[at + 1] - self.first[at]
        entry = np.arange(times.sum()) + np.repeat(self.first[at] - np.cumsum(times) + times, times)
        return np.repeat(found, times), self.template[entry], self.place[entry]


def band_of(length: int) -> int:
    return max(4, length // 8)


def windows(diagonal: np.ndarray, t: np.ndarray, band: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First bucket of every window of ``BUCKETS`` neighbouring buckets of diagonals, and how many of the template's
    places have a hit in it."""
    bucket = diagonal // band
    each = np.unique(np.concatenate([(bucket - s) * length + t for s in range(BUCKETS)]))
    return np.unique(each // length, return_counts=True)


def copies(text: np.ndarray, template: np.ndarray, d: np.ndarray, t: np.ndarray, need: float,
           min_coverage: float, same: Callable[[np.ndarray, np.ndarray], bool]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Disjoint copies of the template, as matched words (of the text, of the template), from the hits (word ``d`` of
    the text, word ``t`` of the template), without those that ``same`` finds to be of another license.

    The window with most of the template's places is aligned first; a copy found there splits the text, and both
    sides are searched on their own.
    """
    band, length = band_of(len(template)), len(template)
    bag = np.unique(template, return_counts=True)
    todo = [(0, len(text), d, t)]
    while todo:
        lo, hi, d, t = todo.pop()
        if len(d) < need:
            continue
        diagonal = d - t
        start, count = windows(diagonal, t, band, length)
        start, count = start[count >= need], count[count >= need]
        tried = set()
        while len(start):
            best = np.flatnonzero(count == count.max())
            best = int(best[len(best) // 2])            # of many equal copies the middle one: both sides are halves
            inside = diagonal[(diagonal // band >= start[best]) & (diagonal // band < start[best] + BUCKETS)]
            start, count = np.delete(start, best), np.delete(count, best)
            low, high = int(inside.min()), int(inside.max())
            if (low, high) in tried:
                continue
            tried.add((low, high))
            begin, stop = max(lo, low - band), min(hi, high + band + length)
            if shared(text[begin:stop], bag) < min_coverage * length:
                continue                                # no path can match enough words
            values, times = np.unique(inside, return_counts=True)
            at = int(values[times.argmax()])
            if lo <= at and at + length <= hi and np.array_equal(text[at:at + length], template):
                found = np.arange(at, at + length), np.arange(length)
            else:
                found = align(text, template, low - band, high + band, begin, stop)
            if len(found[0]) < min_coverage * length:
                continue
            if same(*found):
                yield found
            a, b = int(found[0][0]), int(found[0][-1]) + 1
            todo += [(lo, a, d[d < a], t[d < a]), (b, hi, d[d >= b], t[d >= b])]
            break


def shared(text: np.ndarray, bag: tuple[np.ndarray, np.ndarray]) -> int:
    """Words in common, by their numbers alone."""
    at = np.minimum(np.searchsorted(bag[0], text), len(bag[0]) - 1)
    return int(np.minimum(np.bincount(at[bag[0][at] == text], minlength=len(bag[0])), bag[1]).sum())


#: One cell of the alignment in one number: score, matched words, first word.
SCORE, MATCHED = 1 << 42, 1 << 21


def align(text: np.ndarray, template: np.ndarray, low: int, high: int, begin: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Best local path over diagonals low to high in the words begin to stop: its matched words, of text and template."""
    own = text[begin:stop]
    shift, width = low - begin, high - low + 1
    # Column c of row t is word t + shift + c of ``own``.
    steps = np.arange(width) * SCORE
    moves = np.zeros((len(template), width), np.int8)
    above, best, end = np.zeros(width + 1, np.int64), 0, (0, 0)
    for t in range(len(template)):
        row = np.zeros(width + 1, np.int64)
        a, b = max(0, -t - shift), min(width, len(own) - t - shift)
        if a < b:
            words_ = slice(t + shift + a, t + shift + b)
            same = own[words_] == template[t]
            corner, up = above[a:b], above[a + 1:b + 1] - SCORE
            fresh = np.arange(words_.start + 1, words_.stop + 1)
            step = np.where(same, np.where(corner > 0, corner, fresh) + 2 * SCORE + MATCHED, corner - SCORE)
            cell = np.maximum(step, up)
            cell[cell < SCORE] = 0
            level = np.maximum.accumulate(cell + steps[a:b]) - steps[a:b]
            level[level < SCORE] = 0
            move = np.where(level > cell, LEFT, np.where(up > step, UP, np.where(same, SAME, OTHER)))
            move[level == 0] = 0
            moves[t, a:b] = move
            row[a:b] = level
            top = int(level.argmax())
            if level[top] > best:
                best, end = int(level[top]), (t, a + top)
        above = row
    t, c = end
    pairs = []
    while t >= 0 and moves[t, c]:
        move = moves[t, c]
        if move == SAME:
            pairs.append((begin + t + shift + c, t))
        t, c = t - (move != LEFT), c + (move == UP) - (move == LEFT)
    found = np.array(pairs[::-1], np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def same_license(text: bytes, spans: tuple[np.ndarray, np.ndarray], at_text: np.ndarray, at_template: np.ndarray,
                 telling: np.ndarray) -> bool:
    """Whether all telling words are matched, in numbers that are not parts of others, with no variant between them."""
    if not np.isin(telling, at_template).all():
        return False
    matched = set(at_text.tolist())
    for w in range(int(at_text[0]), int(at_text[-1]) + 1):
        if w not in matched and text[spans[0][w]:spans[1][w]].decode("utf-8", "replace").lower() in VARIANTS:
            return False
    for w in at_text[np.isin(at_template, telling)].tolist():
        a, b = int(spans[0][w]), int(spans[1][w])
        if text[b - 1:b].isdigit():
            if w - 1 not in matched and re.search(rb"[0-9]\.$", text[max(0, a - 2):a]):
                return False
            if w + 1 not in matched and re.match(rb"\.[0-9]*[1-9]", text[b:b + 9]):
                return False
    return True


def scan(texts: list[bytes], index: Index, min_share: float = MIN_SHARE, min_coverage: float = MIN_COVERAGE) -> list[list[dict]]:
    """Matches of each text, the lesser ones among them."""
    out: list[list[dict]] = [[] for _ in texts]
    starts, ends, hashes, owner = words(texts)
    at, gram = grams(hashes, owner, index.k)
    place, template, t = index.hits(gram)
    kept = np.zeros(len(gram), bool)
    kept[winnow(gram, owner[at], index.window)] = True
    asked = kept[place] | index.short[template]
    place, template, t = place[asked], template[asked], t[asked]
    if not len(place):
        return out
    word = at[place]
    first_word = np.searchsorted(owner, np.arange(len(texts) + 1))
    begins = np.cumsum([0] + [len(x) + 1 for x in texts]).tolist()
    need = min_share * np.array(index.prints)
    pair = owner[word] * len(need) + template
    order = np.argsort(pair, kind="stable")
    pair, word, t = pair[order], word[order], t[order]
    longest = max(map(len, index.words))
    pairs, places = np.unique(np.unique(pair * longest + t) // longest, return_counts=True)
    for p in pairs[places >= need[pairs % len(need)]].tolist():
        i, template = divmod(p, len(need))
        own, lo, hi = index.words[template], int(first_word[i]), int(first_word[i + 1])
        part = slice(*np.searchsorted(pair, [p, p + 1]).tolist())
        spans = starts[lo:hi] - begins[i], ends[lo:hi] - begins[i]

        def same(at_text: np.ndarray, at_template: np.ndarray) -> bool:
            return len(own) > SHORT or same_license(texts[i], spans, at_text, at_template, index.telling[template])

        found = copies(hashes[lo:hi], own, word[part] - lo, t[part], need[template], min_coverage, same)
        for at_text, _ in sorted(found, key=lambda f: int(f[0][0])):
            a, b, matched = int(at_text[0]), int(at_text[-1]) + 1, len(at_text)
            head = len(texts[i][:int(spans[0][a])].decode("utf-8", "replace"))
            body = texts[i][int(spans[0][a]):int(spans[1][b - 1])].decode("utf-8", "replace")
            out[i].append({"template": index.names[template], "coverage": matched / len(own), "matched_words": matched,
                           "start_word": a, "end_word": b, "start_char": head, "end_char": head + len(body),
                           "gaps": b - a + len(own) - 2 * matched, "at": at_text})
    for found in out:
        taken: set[int] = set()
        for m in sorted(found, key=lambda m: (-m["matched_words"], m["gaps"])):
            at_text = m.pop("at").tolist() if len(found) > 1 else []
            m["lesser"] = 2 * len(taken.intersection(at_text)) >= max(len(at_text), 1)
            if not m["lesser"]:
                taken.update(at_text)
    return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, min_share: float = MIN_SHARE,
                  min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_matches, licenses, matches, lesser) per row; matches in order of template, then place."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int32()),
                               ("start_word", pa.int32()), ("end_word", pa.int32()), ("start_char", pa.int32()),
                               ("end_char", pa.int32())]))

    held = docs.sparkSession.sparkContext.broadcast(Index(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            found: list[list[dict]] = []
            lo = 0
            while lo < len(texts):
                hi, room = lo, BLOCK_BYTES
                while hi < len(texts) and (hi == lo or room >= len(texts[hi])):
                    room -= len(texts[hi])
                    hi += 1
                found += scan(texts[lo:hi], index, min_share, min_coverage)
                lo = hi
            parts = [pa.array([[m for m in ms if m["lesser"] == lesser] for ms in found], kind) for lesser in (False, True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *parts], ["doc", "matches", "lesser"])

    matched = rows.mapInArrow(run, f"doc {like_type(rows, 'doc')}, matches array<struct<{MATCH}>>, lesser array<struct<{MATCH}>>")
    return matched.select("doc", F.size("matches").cast("long").alias("n_matches"),
                          F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["template"]))).alias("licenses"), "matches",
                          "lesser")
