"""Find benchmark items in documents, also with other numbers, names or units in them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeflow.llm.matching import rows_with_keys
from fringeflow.sources.stage_store import settle

WINDOW = 8
# A benchmark window needs so many plain words to say anything.
MIN_LITERALS = 4
# Windows in a row that make a document contaminated: 12 words.
MIN_WINDOWS = 5
# Hashes of benchmark windows to broadcast at most; a hundred bytes each.
BROADCAST_WINDOWS = 1_000_000

# What tells rows of documents apart.
ROW = ["doc_id", "text_hash"]

# Marks of placeholders, by type.
NAME, NUMBER, UNIT, POINT = "\x01", "\x02", "\x03", "\x04"

# Units that may follow a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "ml", "l", "s", "min", "h",
    "hours", "minutes", "seconds", "days", "weeks", "months", "years", "meters", "miles", "dollars", "euros", "cents",
    "percent", "degrees", "mph", "kmh",
)


def marked_words(text: Column) -> Column:
    """Lower-case words of a text; names, numbers and units carry the mark of their type before their value.

    A name is a capitalised word inside a sentence, whatever white space is
    before it, a number a run of digits with inner points or commas, a unit a
    word of ``UNITS`` after a number. Apostrophes are left out.
    """
    text = F.translate(text, NAME + NUMBER + UNIT + POINT + "'\u2019", "    ")
    text = F.regexp_replace(text, r"(?<=\d)[.,](?=\d)", POINT)
    text = F.regexp_replace(text, r"(?<=[\p{L}\d,;])[\s\p{Z}]+(?=\p{Lu}\p{Ll})", f" {NAME}")
    text = F.regexp_replace(text, rf"(?<![\p{{L}}\d{POINT}])\d[\d{POINT}]*", f" {NUMBER}$0 ")
    text = F.regexp_replace(text, rf"(?<=\d )\s*(?=(?:{'|'.join(UNITS)})(?![\p{{L}}\d]))", f" {UNIT}")
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}{NAME}-{POINT}]+"), F.lit(0))


def is_slot(word: Column) -> Column:
    return word < "\x05"


def _has_marks(word: Column) -> Column:
    return is_slot(word) | F.contains(word, F.lit(POINT))


def plain_word(word: Column) -> Column:
    """The word without marks, and a number without points and commas."""
    return F.when(_has_marks(word), F.translate(word, NAME + NUMBER + UNIT + POINT, "")).otherwise(word)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _full_windows(codes: Column, step: int = 1) -> Column:
    """Hash of each run of 8 codes by its place, null without a full run. Built by doubling: pairs, pairs of pairs, and so on."""
    if step == WINDOW:
        return codes
    later = F.slice(codes, F.lit(step + 1), F.greatest(F.size(codes), F.lit(1)))
    both = F.zip_with(codes, later, lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    return _bind(both, lambda pairs: _full_windows(pairs, 2 * step))


def _codes(words: Column, exact: bool) -> Column:
    """Hash of each word; slots count as their type only, unless ``exact``."""
    if exact:
        return F.transform(words, lambda w: F.xxhash64(plain_word(w)))
    return F.transform(words, lambda w: F.xxhash64(F.when(is_slot(w), F.substring(w, 1, 1)).otherwise(w)))


def window_hashes(words: Column, exact: bool = False) -> Column:
    """Hash of the template, or the ``exact`` words, of each run of 8 words, by its place; of fewer words, of all together.

    Places without a full run are null.
    """

    def hashed(codes: Column) -> Column:
        return F.when(F.size(codes) < WINDOW, F.array(F.xxhash64(codes))).otherwise(_full_windows(codes))

    return _bind(_codes(words, exact), hashed)


def own_length_hashes(words: Column, lengths: Sequence[int], exact: bool) -> Column:
    """For 8 and each shorter length one array after the other, each as long as ``words``: ``window_hashes`` of that many words."""

    def short(codes: Column, k: int) -> Column:
        return F.transform(codes, lambda _, i: F.when(i + k <= F.size(codes), F.xxhash64(F.slice(codes, i + 1, F.lit(k)))))

    def hashed(codes: Column) -> Column:
        return F.concat(_full_windows(codes), *[short(codes, k) for k in lengths])

    return _bind(_codes(words, exact), hashed)


def benchmark_windows(benchmark: DataFrame, copies: bool) -> DataFrame:
    """``hash, item_id, exact, place, window`` of every template that has enough plain words; with ``copies`` also of all exact windows."""
    items = settle(benchmark.select("item_id", marked_words(F.col("text")).alias("words")).where("size(words) > 0"), "items")
    windows = _windows_of(items, exact=False)
    plain = F.size(F.filter("window", lambda w: ~is_slot(w)))
    windows = windows.where(plain * WINDOW >= F.size("window") * MIN_LITERALS)
    if copies:
        windows = windows.unionByName(_windows_of(items.withColumn("words", F.transform("words", plain_word)), exact=True))
    return windows.select("hash", "item_id", "exact", "place", "window")


def _windows_of(items: DataFrame, exact: bool) -> DataFrame:
    windows = items.select("item_id", "words", F.posexplode(window_hashes(F.col("words"), exact)).alias("place", "hash"))
    window = F.slice("words", F.col("place") + 1, F.lit(WINDOW))
    return windows.where("hash is not null").select("*", F.lit(exact).alias("exact"), window.alias("window"))


def _alignments(docs: DataFrame, benchmark: DataFrame, copies: bool) -> DataFrame:
    """Windows and slots of each row of ``docs``, item and shift, and whether they are a leak."""
    bench = settle(benchmark_windows(benchmark, copies).distinct(), "bench_windows")
    hashes = bench.select("hash").distinct()
    if bench.count() <= BROADCAST_WINDOWS:
        hashes = F.broadcast(hashes)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    words = marked_words(F.col("text"))
    n, every = F.lit(1), window_hashes(F.col("words"))
    if copies:
        short = bench.select(F.size("window").alias("k")).where(f"k < {WINDOW}").distinct().collect()
        n, lengths = F.size("words"), sorted(r["k"] for r in short)
        # Without a mark in any word the exact hashes are those of the templates.
        marks = F.exists("words", _has_marks)
        exact = F.when(marks, own_length_hashes(F.col("words"), lengths, True)).otherwise(F.array().cast("array<bigint>"))
        every = F.concat(own_length_hashes(F.col("words"), lengths, False), exact)
    found = docs.withColumn("words", words).select(*ROW, n.alias("n"), F.posexplode(every).alias("at", "hash"))
    found = found.join(hashes, "hash").selectExpr(*ROW, "at % n as at" if copies else "at", "hash")
    found = settle(found.distinct(), "found")

    # Of the few documents found, the words at the places found.
    places = found.groupBy(*ROW).agg(F.collect_set(F.struct("at", "hash")).alias("ats"))
    texts = rows_with_keys(docs, places, ROW).select(*ROW, words.alias("words"))
    texts = texts.join(places, [texts[c].eqNullSafe(places[c]) for c in ROW]).select(*[texts[c] for c in ROW], "ats", "words")
    theirs = F.slice("words", F.col("a.at") + 1, F.lit(WINDOW)).alias("theirs")
    texts = texts.select(*ROW, "words", F.explode("ats").alias("a")).select(*ROW, "a.at", "a.hash", theirs)
    pairs = settle(texts.join(bench, "hash").selectExpr("*", "at - place as shift").distinct(), "pairs")

    key = [*ROW, "item_id", "exact", "shift"]
    slots = pairs.select(*key, F.explode(F.arrays_zip("window", "theirs")).alias("slot"))
    slots = slots.where(is_slot(F.col("slot.window"))).distinct()
    judged = slots.groupBy(*key).agg(
        F.count("*").alias("n_slots"),
        F.countDistinct("slot.window").alias("n_ours"),
        F.countDistinct("slot.theirs").alias("n_theirs"),
        F.sum(F.expr("cast(slot.window <> slot.theirs as bigint)")).alias("n_changed"),
    )
    runs = pairs.groupBy(*key).agg(F.countDistinct("place").alias("n_windows"))
    same = [runs[c].eqNullSafe(judged[c]) for c in key]
    runs = runs.join(judged, same, "left").select(*[runs[c] for c in key], "n_windows", "n_slots", "n_ours", "n_theirs", "n_changed")
    sizes = bench.groupBy("item_id", "exact").agg(F.countDistinct("place").alias("n_item"))
    of_item = runs["item_id"].eqNullSafe(sizes["item_id"]) & (runs["exact"] == sizes["exact"])
    runs = runs.join(sizes, of_item).select(runs["*"], "n_item")
    runs = runs.selectExpr(
        *ROW, "item_id", "n_windows", "coalesce(n_slots, 0L) as n_slots", "coalesce(n_changed, 0L) as n_changed",
        "coalesce(n_slots = n_ours and n_slots = n_theirs, true) as consistent", f"least({MIN_WINDOWS}, n_item) as enough",
    )
    return runs.selectExpr("*", "consistent and n_windows >= enough as leaked")


def find_leaks(docs: DataFrame, benchmark: DataFrame, copies: bool = False) -> DataFrame:
    """``doc_id, item_id, n_windows, n_slots, n_changed, consistent, leaked`` for documents that share windows with items.

    Numbers, names and units become typed placeholders; windows of 8 words
    meet in a hash join. Along one alignment of item and document, each slot
    value of the item must stand for one value of the document and the other
    way round (``consistent``); ``n_changed`` counts values that differ. Of
    several alignments the best one is kept. ``leaked``: consistent, and at
    least 5 windows, or all windows of a shorter item.

    Templates depend on capitals and sentence ends, and those with under
    half plain words are left out. With ``copies`` the windows also meet by
    their exact words, whatever they are, without case, white space and
    punctuation, counted by themselves; so copies are found in any layout.

    Texts under 8 words are one window, so they only meet texts of the same
    template. With ``copies`` an item under 8 words is looked for at every
    place of every document, by its exact words, and by its template if half
    its words are plain; one of a single word is found wherever that word is.
    Null and empty texts have no window. Different texts of one doc_id, null
    included, are judged one by one, and the best result is returned; rows of
    one item_id are judged together. Repeated rows change nothing.
    Other columns are ignored; empty tables give no rows.
    """
    best = "max(struct(leaked, consistent, n_windows, -n_changed as unchanged, n_slots))"
    best = _alignments(docs, benchmark, copies).groupBy("doc_id", "item_id").agg(F.expr(best).alias("b"))
    return best.selectExpr(
        "doc_id", "item_id", "b.n_windows", "b.n_slots", "-b.unchanged as n_changed", "b.consistent", "b.leaked"
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows whose own text has no leaked item, nor a copy of one; other rows of the same doc_id stay."""
    leaked = _alignments(docs, benchmark, copies=True).where("leaked").select(*ROW).distinct()
    leaked = settle(leaked, "leaked")
    same = docs["doc_id"].eqNullSafe(leaked["doc_id"]) & (F.xxhash64(docs["text"]) == leaked["text_hash"])
    return docs.join(leaked, same, "left_anti")
