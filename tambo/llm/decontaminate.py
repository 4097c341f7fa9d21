"""Benchmark decontamination: n-gram windows of benchmark items looked up in training texts.

Both sides are normalised alike (A-Z lower-cased, words are runs of digits,
letters a-z and characters from U+0080 on).  An item gives its windows of ``n``
consecutive words; an item of fewer words, but not none, is one window.  Every
window of a text is hashed and probed against the set of benchmark hashes; a
match is verified word by word, and hit windows are merged into word spans.

All steps are DataFrame expressions.  The window set is broadcast only when its
measured size is at most ``MAX_BROADCAST_BYTES``; beyond that the same join
shuffles on the window hash.  Whole texts are read, however long; the words of
one text are one array.

Defined results: a null or empty text has no words and is never contaminated;
items that are null or have no words give no window; an empty item table leaves
every text clean; repeated items count once (items are told apart by id);
repeated rows of documents each get their own row; a null id is kept as a key
of its own: all items with a null id are one item, a null at the end of ``items``
that ``n_items`` counts (the query's ``items_sha256`` joins the ids that are not null,
as its SQL does).  Only the named id and text columns are read, and names used on the
way avoid those of the input, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tambo.llm.common import ascii_lower, checkpointed, own_names, text_key

#: Words before A-Z are lower-cased, and what stands between them.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of the windows (text, hash and length) up to which they are broadcast.
MAX_BROADCAST_BYTES = 32 << 20
#: Hash of the entry behind a text's windows; told from a window of equal hash by its place.
COUNTED = 0


def words_of(text: Column) -> Column:
    """The words of a text; null for null.  Cutting between words is several times cheaper than finding each word."""
    return F.filter(F.split(ascii_lower(text), BETWEEN), lambda w: w != "")


def item_windows(items: DataFrame, n: int, item_id: str, item_text: str) -> DataFrame:
    """(item, length, window, hash): each item's distinct windows."""
    words = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("words"))
    sized = words.filter(F.size("words") > 0).withColumn("length", F.least(F.lit(n), F.size("words")))
    starts = sized.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)))
    window = starts.select("item", "length", F.slice("words", F.col("at"), F.col("length")).alias("window"))
    return window.select("item", "length", F.array_join("window", " ").alias("window"),
                         F.xxhash64(word_hashes(F.col("window"))).alias("hash")).distinct()


def _bounded(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= MAX_BROADCAST_BYTES else df


def contamination(docs: DataFrame, items: DataFrame, n: int = 13, words_per_hit: int = 20, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row: id, text key, n_words, n_hit, n_items, items, spans, contaminated.

    ``spans`` are the merged hit ranges of words (first, end exclusive);
    ``items`` the sorted ids of items with an occurring window; a document is
    contaminated when n_hit > 0 and ``words_per_hit`` * n_hit >= n_words.
    """
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    windows = checkpointed(item_windows(items, n, item_id, item_text))
    size = windows.agg(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 32)).first()[0] or 0
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())    # at most n values
    sized, hits = document_hits(base, windows, size, lengths)
    found = hits.groupBy("doc", "key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("hit"))
    found = found.select("doc", "key", _merged(F.col("hit")).alias("spans"))
    member = windows.select("window", "item")
    listed = (hits.select("doc", "key", "window").distinct().join(_bounded(member, size), "window")
                  .groupBy("doc", "key").agg(F.array_sort(F.transform(F.collect_set(F.struct("item")), lambda s: s["item"])).alias("items")))
    found = found.join(listed.withColumnsRenamed({"doc": "doc2", "key": "key2"}),
                       F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("key") == F.col("key2"))).drop("doc2", "key2")
    out = sized.join(found.withColumnsRenamed({"doc": "doc2", "key": "key2"}),
                     F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("key") == F.col("key2")), "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "doc", "key", "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    ).withColumn("n_items", F.size("items").cast("long")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (words_per_hit * F.col("n_hit") >= F.col("n_words")))


def document_hits(base: DataFrame, windows: DataFrame, size: int, lengths: list[int]) -> tuple[DataFrame, DataFrame]:
    """(doc, key, n_words) of every row, and (doc, key, window, start, end) for every verified window occurrence.

    Each text's window hashes, for every window length that occurs, are laid
    end to end in one array, so one probe serves all lengths.  Where the windows
    are broadcast, one more entry behind them finds a row without a window, which
    carries the text's number of words: each text is cut into words once.
    """
    words = base.select("doc", text_key(F.col("text")).alias("key"),
                        F.coalesce(words_of(F.col("text")), F.array().cast("array<string>")).alias("words"))
    sized = words.select("doc", "key", F.size("words").cast("long").alias("n_words"))
    if not lengths:
        return sized, sized.select("doc", "key", F.lit("").alias("window"), F.lit(0).alias("start"),
                                   F.lit(0).alias("end")).filter(F.lit(False))
    local = size <= MAX_BROADCAST_BYTES
    words = words.withColumn("hashes", word_hashes(F.col("words")))
    count = {m: F.greatest(F.size("words") - (m - 1), F.lit(0)) for m in lengths}
    hashes = [window_hashes(F.col("hashes"), m) for m in lengths] + ([F.array(F.lit(COUNTED).cast("long"))] if local else [])
    # The outer form, whose null row of an empty array finds no match: for the inner form Spark would add a filter on
    # the array's size and compute every hash twice.
    probed = words.select("doc", "key", "words", F.posexplode_outer(F.concat(*hashes) if len(hashes) > 1 else hashes[0]).alias("at", "hash"))
    distinct = windows.select("hash", "window").distinct()
    offset, length, before = F.lit(0), F.lit(lengths[0]), F.lit(0)
    for m in lengths:
        offset = F.when(F.col("at") >= before, before).otherwise(offset)
        length = F.when(F.col("at") >= before, m).otherwise(length)
        before = before + count[m]
    start, counted = (F.col("at") - offset).alias("start"), (F.col("at") == before).alias("counted")
    window = F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " ")
    spans = ["doc", "key", "window", "start", (F.col("start") + F.col("length")).alias("end")]
    if local:
        # Probed where the text's words are; only matches go on, so the words are at hand to verify them.
        table = distinct.unionByName(base.sparkSession.range(1).select(F.lit(COUNTED).cast("long").alias("hash"), F.lit(None).cast("string").alias("window")))
        joined = probed.join(F.broadcast(table), "hash").select("doc", "key", "words", "window", start, length.alias("length"), counted)
        found = joined.filter(F.when(F.col("counted"), F.col("window").isNull()).otherwise(F.coalesce(window == F.col("window"), F.lit(False))))
        rows = checkpointed(found.select(*spans, F.when(F.col("counted"), F.size("words").cast("long")).alias("n_words")))
        return (rows.filter(F.col("n_words").isNotNull()).select("doc", "key", "n_words"),
                rows.filter(F.col("n_words").isNull()).drop("n_words"))
    # Rows move to the windows: each takes its own window along, not the text.
    placed = probed.select("doc", "key", "words", "hash", start, length.alias("length"))
    found = placed.select("doc", "key", "hash", "start", "length", window.alias("window")).join(distinct, ["hash", "window"])
    return sized, checkpointed(found.select(*spans))       # read twice; hits only


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hashes(hashes: Column, m: int) -> Column:
    """Hash of every run of ``m`` consecutive words, by start, from the words' hashes."""
    starts = F.sequence(F.lit(1), F.size(hashes) - (m - 1))
    return (F.when(F.size(hashes) >= m, F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, F.lit(m)))))
             .otherwise(F.array().cast("array<bigint>")))


def _merged(spans: Column) -> Column:
    """Sorted word ranges -> disjoint ranges: each range keeps what the ones before it do not cover, then
    adjoining ranges are joined where the next begins."""
    empty = F.struct(F.lit(0).alias("reach"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, s):
        last = F.element_at(acc["out"], -1)
        grown = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1),
                         F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        fresh = F.concat(acc["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        joins = (F.size(acc["out"]) > 0) & (s["start"] <= acc["reach"])
        return F.struct(F.greatest(acc["reach"], s["end"]).alias("reach"), F.when(joins, grown).otherwise(fresh).alias("out"))

    return F.aggregate(spans, empty, step, lambda acc: acc["out"])


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "drop_documents", n: int = 13, words_per_hit: int = 20,
                  id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """The documents with their own columns, without contaminated rows (``drop_documents``) or with the hit words
    of contaminated rows, and what follows each up to the next word, cut out of the text (``remove_spans``)."""
    if mode not in ("drop_documents", "remove_spans"):
        raise ValueError(f"unknown mode: {mode}")
    report = contamination(docs, items, n, words_per_hit, id_col, text_col, item_id, item_text)
    doc, key, cut_spans = own_names(docs, "doc", "key", "spans")
    bad = report.filter("contaminated").select(F.col("doc").alias(doc), F.col("key").alias(key), F.col("spans").alias(cut_spans))
    same = F.col(id_col).eqNullSafe(F.col(doc)) & (text_key(F.col(text_col)) == F.col(key))
    if mode == "drop_documents":
        return docs.join(bad, same, "left_anti")
    joined = docs.join(bad.dropDuplicates([doc, key]), same, "left")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"{WORD}(?:{BETWEEN})?"), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.exists(cut_spans, lambda s: (s["start"] <= i) & (i < s["end"])))
    cut = F.concat(F.regexp_extract(F.col(text_col), f"^(?:{BETWEEN})?", 0), F.array_join(kept, ""))
    columns = [f"`{c}`" for c in docs.columns]
    return joined.withColumn(text_col, F.when(F.col(cut_spans).isNull(), F.col(text_col)).otherwise(cut)).select(*columns)
