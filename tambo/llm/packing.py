"""Best-fit packing of token sequences by bin completion with branch and bound.

Texts become token ids (plus an end id) and pieces of at most ``size`` tokens.
Packing depends on piece lengths alone, of which there are at most ``size``, so
the search works on the histogram of lengths, which is bounded however many
pieces there are:

* the largest remaining length opens a sequence;
* its undominated fillings, of any number of pieces, are enumerated on demand for
  waste 0, 1, ..., the largest pieces first (depth first over the lengths, led by
  the sums that the shorter ones can reach); best fit comes first of those of
  its waste.  A filling is dominated when some of its pieces can be changed for
  one longer, or equally long, piece that is left;
* the filling is used as often as its lengths last, and less often when the search
  comes back to it after all others;
* the whole solution found that way is the first incumbent; branch and bound
  then backtracks over the other fillings and drops a branch when the sequences
  used so far plus the bound of what is left (tokens, and pieces too long to
  share) reach the incumbent, and fillings whose waste alone would.  It ends at
  the bound, after all branches, or after ``nodes`` nodes or ``STEPS`` steps of
  enumeration a node on average; the best solution by then is returned.

A solution is a list of patterns with multiplicities.  Pieces are numbered
within their length (row numbers in hash buckets plus bucket offsets, so a
length that a third of all pieces share is spread), and the number within the
length names pattern, sequence and offset.

Token ids are those of the library for the given vocabulary file.  Words, or
stretches between spaces, tabs and line ends, are coded on their own and short
words remembered: none of the vocabulary's words, special strings or normalisations
spans white space.  ``TokenCache`` must not be used for vocabularies that join
words over spaces.

Defined results: null counts as empty; a text without tokens is the end id
alone; repeated rows each get their own pieces (identical ones are
interchangeable); an empty table gives no rows; only the id and text columns
are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tambo.llm.common import checkpointed, like_type
from tambo.llm.token_counts import byte_symbols

#: Remembered words per worker, and the longest one remembered.
CACHE, CACHE_CHARS = 300_000, 64
#: Pieces of one length that one task numbers, about.
BUCKET_ROWS = 500_000
#: Steps of the enumeration of fillings for each node that the search may visit.
STEPS = 1_000
GAP = re.compile(r"[ \t\r\n]+")
#: Characters that neither the normaliser's composition nor its lower-casing treats in context.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: Whole texts of such characters and the white space between them.
PLAIN_TEXT = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f \t\r\n]*")
#: The vocabulary's words, for lower-cased plain characters (a fixed value of its file format).
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u024f \t\r\n]+")
BYTE_SYMBOLS = byte_symbols()


# ------------------------------------------------------------------ tokens
class TokenCache:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    Texts of printable ASCII and Latin letters, in composed form, are lower-cased and cut into
    words here, and only unknown words go to the library's merge model, whose normaliser is by
    far the slowest part; any other stretch between white space goes through the whole library.

    The ids of known words lie end to end in one array.  A full table keeps the half of its words
    that occurred most, and halves their counts.
    """

    def __init__(self, path: str, room: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.room = room
        #: Number of each known word; a stretch for the whole library is the one member of a tuple.
        self.place: dict[str | tuple[str], int] = {}
        self.ids = np.empty(0, "<u4")
        self.start, self.hits = np.zeros(1, np.int64), np.empty(0, np.int64)

    def code(self, word: str | tuple[str]) -> list[int]:
        if isinstance(word, tuple):
            return self.tokenizer.encode(word[0], add_special_tokens=False).ids
        symbols = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_SYMBOLS)
        return [t.id for t in self.model.tokenize(symbols)]

    def words(self, text: str) -> list[str | tuple[str]]:
        if PLAIN_TEXT.fullmatch(text) and "<|" not in text:
            return WORDS.findall(text.lower())
        out: list[str | tuple[str]] = []
        for stretch in GAP.split(text):
            if PLAIN.fullmatch(stretch) and "<|" not in stretch:
                out += WORDS.findall(stretch.lower())
            elif stretch:
                out.append((stretch,))
        return out

    def keep(self, numbers: np.ndarray) -> None:
        """Only the words of these numbers (ascending) stay known, in their order."""
        kept = set(numbers.tolist())
        names = [w for w, at in self.place.items() if at in kept]      # in order of their numbers
        counts = np.diff(self.start)[numbers]
        start = np.concatenate(([0], np.cumsum(counts)))
        self.ids = self.ids[np.repeat(self.start[numbers] - start[:-1], counts) + np.arange(start[-1])]
        self.start, self.hits = start, self.hits[numbers]
        self.place = {w: i for i, w in enumerate(names)}

    def learn(self, new: list) -> list:
        """Adds words that are not known; those too long to stay, which come last."""
        long = [w for w in new if isinstance(w, tuple) or len(w) > CACHE_CHARS]
        if long:
            new = [w for w in new if isinstance(w, str) and len(w) <= CACHE_CHARS] + long
        coded = [self.code(w) for w in new]
        first = len(self.place)
        self.place.update((w, first + i) for i, w in enumerate(new))
        self.ids = np.concatenate((self.ids, np.array([t for c in coded for t in c], "<u4")))
        ends = self.start[-1] + np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        self.start = np.concatenate((self.start, ends))
        self.hits = np.concatenate((self.hits, np.zeros(len(new), np.int64)))
        return long

    def numbers(self, words: list) -> tuple[np.ndarray, list]:
        """The number of each word, and the words that stay known for this time only."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        gaps = np.flatnonzero(at < 0).tolist()
        if not gaps:
            return at, []
        new = list(dict.fromkeys([words[i] for i in gaps]))
        if len(self.place) + len(new) > self.room and len(self.place) > self.room // 2:
            self.keep(np.sort(np.argsort(-self.hits, kind="stable")[:self.room // 2]))
            self.hits //= 2
            return self.numbers(words)
        passing = self.learn(new)
        at[gaps] = list(map(self.place.__getitem__, [words[i] for i in gaps]))
        return at, passing

    def encode(self, texts: list[str]) -> list[bytes]:
        per_text = [self.words(t) for t in texts]
        words = [w for ws in per_text for w in ws]
        at, passing = self.numbers(words)
        self.hits += np.bincount(at, minlength=len(self.hits))
        counts = self.start[at + 1] - self.start[at]
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.repeat(self.start[at] - ends[:-1], counts) + np.arange(ends[-1])]
        borders = ends[np.cumsum([0] + [len(ws) for ws in per_text])]
        for w in passing:
            del self.place[w]
        if passing:
            left = len(self.place)
            self.ids, self.start, self.hits = self.ids[:self.start[left]], self.start[:left + 1], self.hits[:left]
        return [ids[lo:hi].tobytes() for lo, hi in zip(borders[:-1], borders[1:])]


@lru_cache(maxsize=2)
def token_cache(path: str) -> TokenCache:
    return TokenCache(path)


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """(doc, piece, start, length, ids_crc32[, ids]) per piece of at most ``size`` tokens."""
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = int(end_id).to_bytes(4, "little")
    names = ["doc", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = token_cache(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                source, number, ids = [], [], []
                for i, coded in enumerate(cache.encode(part.column(1).to_pylist())):
                    coded += end
                    for k in range(0, len(coded), 4 * size):
                        source.append(i)
                        number.append(k // (4 * size))
                        ids.append(coded[k:k + 4 * size])
                columns = [part.column(0).take(pa.array(source, pa.int32())), pa.array(number, pa.int32()),
                           pa.array([n * size for n in number], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                           pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc {like_type(rows, 'doc')}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return rows.mapInArrow(run, schema + ", ids array<bigint>" * with_ids)


# ------------------------------------------------------------------ bin completion
def lower_bound(counts: np.ndarray, size: int) -> int:
    """Sequences needed at least: by tokens, and by pieces over half a sequence with what cannot join them."""
    lengths = np.arange(len(counts))
    tokens = int((lengths * counts).sum())
    best = -(-tokens // size)
    above = np.cumsum(counts[::-1])[::-1]                       # pieces of at least this length
    weight = np.cumsum((lengths * counts)[::-1])[::-1]
    half = size // 2
    large, large_tokens = (int(above[half + 1]), int(weight[half + 1])) if half + 1 < len(counts) else (0, 0)
    for k in np.flatnonzero(counts[:half + 1])[:64].tolist():
        alone = int(above[size - k + 1]) if 0 < k <= size else 0
        alone_tokens = int(weight[size - k + 1]) if 0 < k <= size else 0
        small = int(weight[k]) - large_tokens
        room = (large - alone) * size - (large_tokens - alone_tokens)
        best = max(best, large + max(0, -(-(small - room) // size)))
    return max(best, large)


def best_fit(counts: np.ndarray, room: int) -> list[int]:
    """Largest pieces that fit, one after another."""
    out, used = [], {}
    length = min(room, len(counts) - 1)
    while length > 0:
        if counts[length] - used.get(length, 0) > 0:
            out.append(length)
            used[length] = used.get(length, 0) + 1
            room -= length
            length = min(room, length)
        else:
            below = np.flatnonzero(counts[:length])
            length = int(below[-1]) if len(below) else 0
    return out


def _reach(lengths: list[int], counts: np.ndarray, room: int) -> list[int]:
    """Sums up to ``room``, as bits, of the pieces of the first 0, 1, ... of the ascending ``lengths``."""
    mask, out = (1 << room + 1) - 1, [1]
    for x in lengths:
        bits, left, step = out[-1], min(int(counts[x]), room // x), 1
        while left:
            step = min(step, left)
            bits |= bits << x * step & mask
            left, step = left - step, step * 2
        out.append(bits)
    return out


def _spread(bits: int, width: int) -> int:
    """Every bit and the ``width`` bits above it."""
    done = 0
    while done < width:
        more = min(done + 1, width - done)
        bits |= bits << more
        done += more
    return bits


def fillings(counts: np.ndarray, room: int, limit: Callable[[], int] | None = None, steps: list[int] | None = None) -> Iterator[list[int]]:
    """Undominated fillings of ``room``: least waste first, up to ``limit()``, then large pieces; best fit is the first of
    its waste.  ``steps[0]`` counts down; at 0 nothing but best fit is offered."""
    incumbent = best_fit(counts, room)
    least = room - sum(incumbent)
    if least == 0:
        yield incumbent
    lengths = np.flatnonzero(counts[:room + 1]).tolist()
    if not lengths:
        if least:
            yield incumbent
        return
    steps = steps or [1 << 60]
    reach = _reach(lengths, counts, room)
    left = {x: int(counts[x]) for x in lengths}
    free = sum(1 << x for x in lengths)

    def search(k: int, target: int, waste: int, taken: list[int], single: int, several: int, free: int) -> Iterator[list[int]]:
        """Fillings of ``target`` from the first ``k`` lengths; ``single`` and ``several`` are the sums of one and of more
        pieces taken, ``free`` the lengths left."""
        if target == 0:
            if not free & (2 << waste) - 1:             # no piece left fits besides
                yield taken
            return
        while k and lengths[k - 1] > target:
            k -= 1
        for i in range(k - 1, -1, -1):
            if not reach[i + 1] >> target & 1:
                return                              # nor is it from fewer lengths
            steps[0] -= 1
            if steps[0] <= 0:
                return
            x = lengths[i]
            if not reach[i + 1] >> target - x & 1:
                continue
            grown = []
            one, more, rest = single, several, target
            while rest >= x and len(grown) < left[x]:
                more |= more << x | one << x
                one |= 1 << x
                rest -= x
                now = free if len(grown) + 1 < left[x] else free & ~(1 << x)
                if (_spread(more, waste) | (_spread(one << 1, waste - 1) if waste else 0)) & now:
                    break                           # dominated, and so is all that holds it
                grown.append((rest, one, more, now))
            for n in range(len(grown), 0, -1):
                rest, one, more, now = grown[n - 1]
                if reach[i] >> rest & 1:
                    yield from search(i, rest, waste, taken + [x] * n, one, more, now)

    for waste in range(room + 1):
        if waste == least and least:
            yield incumbent
        if waste > least and limit is not None and waste > limit():
            return
        if waste < room and reach[-1] >> room - waste & 1:
            for found in search(len(lengths), room - waste, waste, [], 0, 0, free):
                if found != incumbent:
                    yield found
        if steps[0] <= 0:
            if waste < least:
                yield incumbent
            return


def _times(counts: np.ndarray, pattern: list[int]) -> int:
    return min(int(counts[x]) // pattern.count(x) for x in set(pattern))


def _use(counts: np.ndarray, pattern: list[int], times: int) -> None:
    for x in pattern:
        counts[x] -= times


def options(counts: np.ndarray, top: int, size: int, without: frozenset, limit: Callable[[], int],
            steps: list[int]) -> Iterator[tuple[list[int], int, frozenset]]:
    """Patterns that ``top`` opens, how often they are used (as often as can be, then less often), and the patterns that
    need not be tried again for the same length afterwards."""
    own = counts.copy()
    own[top] -= 1
    offered = []
    for filling in fillings(own, size - top, limit, steps):
        pattern = [top, *filling]
        if tuple(pattern) not in without:
            own[top] += 1
            times = _times(own, pattern)
            own[top] -= 1
            offered.append((pattern, times))
            yield pattern, times, without
    for pattern, times in offered:
        without = without | {tuple(pattern)}
        for fewer in range(times - 1, 0, -1):
            yield pattern, fewer, without


def complete(counts: np.ndarray, size: int, nodes: int = 3_000) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, largest first) with multiplicities that use up the histogram
    ``counts[length]``, in as few sequences as the search finds."""
    counts = counts.astype(np.int64).copy()
    goal = lower_bound(counts, size)
    tokens = int((np.arange(len(counts)) * counts).sum())
    path: list[tuple[list[int], int]] = []
    choices: list[Iterator] = []
    best, best_path, used, visited, top = None, [], 0, 0, len(counts) - 1
    placed, steps = 0, [STEPS * nodes]

    def allowed(spare: int) -> Callable[[], int]:
        """Waste that a sequence may have for fewer sequences than the incumbent's, after waste of -``spare``."""
        return lambda: size if best is None else (best - 1) * size - tokens + spare

    def descend(without: frozenset) -> None:
        """Follows the preferred fillings to the end, or until the bound shows that nothing is to be gained."""
        nonlocal visited, top
        step = 0
        while True:
            before = top
            while top > 0 and counts[top] == 0:
                top -= 1
            if top == 0:
                return
            visited += 1
            step += 1
            if best is not None and step % 16 == 1 and used + lower_bound(counts, size) >= best:
                return
            choices.append(options(counts, top, size, without if top == before else frozenset(), allowed(placed - used * size), steps))
            without = take()
            if without is None:
                choices.pop()
                return

    def take() -> frozenset | None:
        """Takes the next choice of the last node; None when there is none."""
        nonlocal used, placed
        choice = next(choices[-1], None)
        if choice is None:
            return None
        pattern, times, without = choice
        _use(counts, pattern, times)
        path.append((pattern, times))
        used += times
        placed += times * sum(pattern)
        return without

    without: frozenset = frozenset()
    while True:
        descend(without)
        if not counts.any() and (best is None or used < best):
            best, best_path = used, list(path)
        if best is not None and (best <= goal or visited >= nodes or steps[0] <= 0):
            return best_path
        while path:
            pattern, times = path.pop()
            _use(counts, pattern, -times)
            used -= times
            placed -= times * sum(pattern)
            top = pattern[0]
            chosen = take()
            if chosen is not None:
                without = chosen
                break
            choices.pop()
        if not choices:
            return best_path


def placements(patterns: list[tuple[list[int], int]], size: int) -> dict[str, np.ndarray]:
    """Ranges of numbers within a length -> (first sequence, offset); ``first`` has each length's first range."""
    nxt = [0] * (size + 1)
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            rows.append((x, nxt[x], sequence, offset))
            nxt[x] += times
            offset += x
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    base = np.concatenate(([0], np.cumsum(nxt)[:-1])).astype(np.int64)
    return {"base": base, "starts": base[table[:, 0]] + table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


# ------------------------------------------------------------------ operator
def numbered(parts: DataFrame, total: int, size: int) -> DataFrame:
    """``parts`` with ``number``: 0-based within their length."""
    buckets = max(16, -(-total // BUCKET_ROWS))
    keyed = parts.withColumn("__b", F.when(F.col("length") < size, F.pmod(F.xxhash64("doc", "piece"), F.lit(buckets)))
                                     .otherwise(F.pmod(F.xxhash64("doc", "piece", "start"), F.lit(buckets * 8))))
    sizes = keyed.groupBy("length", "__b").count()
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__b").orderBy("doc", "piece", "ids_crc32")
    ranked = keyed.withColumn("__n", F.row_number().over(inside)).join(offsets, ["length", "__b"])
    return ranked.withColumn("number", F.col("__before") + F.col("__n") - 1).drop("__b", "__before", "__n")


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, nodes: int = 3_000, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc, piece, start, length, ids_crc32, sequence_id, offset[, ids]) per piece; no sequence exceeds ``size``."""
    parts = checkpointed(pieces(docs, path, size, end_id, id_col, text_col, with_ids))
    counts = np.zeros(size + 1, np.int64)
    for r in parts.groupBy("length").count().collect():         # at most ``size`` rows
        counts[r["length"]] = r["count"]
    held = docs.sparkSession.sparkContext.broadcast(placements(complete(counts, size, nodes), size))
    ranked = numbered(parts, int(counts.sum()), size)
    names = [*parts.columns, "sequence_id", "offset"]
    columns = ranked.select(*parts.columns, "number")
    schema = ", ".join(f"{n} {like_type(parts, n)}" for n in parts.columns) + ", sequence_id bigint, offset bigint"
    length_at = parts.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for batch in batches:
            length = batch.column(length_at).to_numpy(zero_copy_only=False)
            at = p["base"][length] + batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            here = np.searchsorted(p["starts"], at, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p["sequence"][here] + at - p["starts"][here]),
                                              pa.array(p["offset"][here])], names)

    return columns.mapInArrow(run, schema)


def packed_sequences(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, **names) -> DataFrame:
    """(sequence_id, ids, docs): the training rows themselves, at most ``size`` token ids each."""
    placed = pack(docs, path, size, end_id, with_ids=True, **names)
    ordered = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc", "ids"))).alias("parts"))
    return ordered.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
                          F.transform("parts", lambda p: p["doc"]).alias("docs"))
