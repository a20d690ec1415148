"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Words are runs of letters, digits and non-ASCII characters, lower-cased. A
seed is a fixed mask over ten neighbouring words that ignores three of them,
so a hit survives replaced words at the ignored places, or a run of four words
for short items, where replaced words lie close to both ends; all masks keep
their first two words. Every word place of every document is looked at: those whose
first two words also stand side by side in a benchmark item give seeds, which
are joined with the items' seeds. Each hit is an alignment of a document with
an item. Around it the whole item is compared word by word, and the best
stretch is the one with the highest number of equal words less twice the
number of replaced ones; a score of ``min_score`` makes it a leak. So does, for
copies of short items with replaced words, more than a ``min_share`` of the
whole item's words that are equal at one alignment; parts of an item, which
may be equal by chance, need the score.

Items shorter than a mask are looked for whole and unchanged: every window of
an item's length that starts with the words of such an item is joined with the
items by its hash and compared word by word.

The benchmark's seeds and short items are broadcast only after their number
was counted and found small, else both sides are shuffled; then the documents'
places travel as hashes, without their words.

Seeds find every copy with one replaced word in ten, but may miss alignments
that reach the score with more: of the ways to replace two inner words of a
16-word item 1 in 91 is missed, three of 19 words 17 in 680, four of 22 words
60 in 4,845.

Null and empty texts have no leaks. Rows without doc_id are not reported.
Repeated rows, and items with equal texts, are reported alike. Extra columns
are ignored by find_leaks and kept by remove_leaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelattice.llm.store import materialise, unused

# 1 marks a word that counts.
MASKS = ("1110110101", "1101011011", "1100110111", "1111")
SPAN = 10
MIN_SCORE = 10
MIN_SHARE = 0.75
BROADCAST_ROWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; an empty first or last one where it starts or ends with a separator."""
    return F.split(F.lower(text), SEPARATORS)


def _pair() -> Column:
    return F.expr("xxhash64(words[at], get(words, at + 1))")


def _seeds() -> Column:
    """(mask number, hash of the counted words) for each mask at place ``at``; null where it does not fit."""
    out = []
    for m, mask in enumerate(MASKS):
        at = ", ".join(f"get(words, at + {k})" for k, c in enumerate(mask) if c == "1")
        out.append(f"if(at + {len(mask)} <= size(words), xxhash64({m}, {at}), null)")
    return F.expr(f"array({', '.join(out)})")


def _places(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each place where at least the shortest mask fits."""
    span = min(map(len, MASKS))
    return df.where(F.size("words") >= span).select(*keep, "words", F.explode(F.expr(f"sequence(0, size(words) - {span})")).alias("at"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _short_leaks(rows: DataFrame, short: DataFrame) -> DataFrame | None:
    """Whole copies of the items that are shorter than a mask; None where there are no such items."""
    n = {r.n: r["count"] for r in short.groupBy(F.size("words").alias("n")).count().collect()}
    if not n:
        return None
    # A place goes on only if an item starts with its two words, or is its one word.
    single, several = F.xxhash64(F.expr("words[at]")), _pair()
    starts = short.withColumn("at", F.lit(0)).select(F.when(F.size("words") == 1, single).otherwise(several).alias("start"))
    starts = _small(starts.distinct(), sum(n.values()))
    places = rows.where(F.size("words") >= min(n)).select("doc_id", "words", F.explode(F.expr(f"sequence(0, size(words) - {min(n)})")).alias("at"))
    found = []
    for key, lengths in ((single, [k for k in n if k == 1]), (several, [k for k in n if k > 1])):
        if lengths:
            windows = F.filter(F.array(*(F.when(F.col("at") + k <= F.size("words"), F.slice("words", F.col("at") + 1, k)) for k in lengths)), lambda w: w.isNotNull())
            at = places.join(starts, key == F.col("start"), "left_semi") if sum(n.values()) <= BROADCAST_ROWS else places
            at = at.select("doc_id", "at", F.explode(windows).alias("window"))
            items = _small(short.select("item_id", F.col("words").alias("item"), F.xxhash64("words").alias("hash")), sum(n.values()))
            found.append(at.join(items, (F.xxhash64("window") == F.col("hash")) & (F.col("window") == F.col("item"))))
    both = found[0].union(found[1]) if len(found) > 1 else found[0]
    out = both.groupBy("doc_id", "item_id").agg(F.min("at").cast("long").alias("first_word"), F.max(F.size("item")).cast("long").alias("n"), F.count("*").alias("n_places"))
    return out.select("doc_id", "item_id", F.col("n").alias("score"), "first_word", F.col("n").alias("n_words"), F.col("n").alias("n_equal"), F.col("n").alias("item_words"), "n_places")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: int = MIN_SCORE, min_share: float = MIN_SHARE) -> DataFrame:
    """One row for each document and item that overlap: the best stretch, how long it is and with how many equal words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("words")).where("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.filter(words(F.col("text")), lambda w: w != "").alias("words"))
    items = materialise(items.where(F.size("words") > 0), "leak-items")
    short = _short_leaks(rows, items.where(F.size("words") < SPAN))
    items = items.where(F.size("words") >= SPAN)

    mine = materialise(_places(items, "item_id").select("item_id", "at", _pair().alias("pair"), F.posexplode(_seeds()).alias("mask", "seed")).where("seed is not null"), "leak-seeds")
    n = mine.count()
    pairs = _small(mine.select("pair").distinct(), n)
    seeds = _small(mine.select("mask", "seed", "item_id", F.col("at").alias("item_at")), n)

    places = _places(rows, "doc_id")
    if n <= BROADCAST_ROWS:  # only the places that pass the pair test are hashed under the masks
        places = places.join(pairs, _pair() == F.col("pair"), "left_semi").select("doc_id", "at", _seeds().alias("seeds"))
    else:
        places = places.select("doc_id", "at", _pair().alias("pair"), _seeds().alias("seeds")).join(pairs, "pair", "left_semi")
    hits = places.select("doc_id", "at", F.posexplode("seeds").alias("mask", "seed")).where("seed is not null").join(seeds, ["mask", "seed"])
    hits = materialise(hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "leak-hits")

    # Alignments are compared word by word; only documents with a hit are read again.
    again = rows.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    both = hits.join(again, "doc_id").join(items.select("item_id", F.col("words").alias("item")), "item_id")
    equal = "transform(item, (w, i) -> if(shift + i >= 0, coalesce(get(words, cast(shift + i as int)) = w, false), false))"
    both = both.select("doc_id", "item_id", "shift", F.size("item").alias("item_words"), F.expr(equal).alias("equal"))
    stretch = """aggregate(equal, named_struct('i', 0, 'from', 0, 'sum', 0, 'best', 0, 'lo', 0, 'hi', 0),
      (s, e) -> named_struct(
        'i', s.i + 1,
        'from', if(s.sum + if(e, 1, -2) <= 0, s.i + 1, s.from),
        'sum', greatest(s.sum + if(e, 1, -2), 0),
        'best', greatest(s.best, s.sum + if(e, 1, -2)),
        'lo', if(s.sum + if(e, 1, -2) > s.best, s.from, s.lo),
        'hi', if(s.sum + if(e, 1, -2) > s.best, s.i + 1, s.hi)))"""
    share = F.size(F.filter("equal", lambda e: e)) > min_share * F.col("item_words")
    scored = both.withColumn("s", F.expr(stretch)).where((F.col("s.best") >= min_score) | share)
    found = scored.select(
        "doc_id",
        "item_id",
        F.col("s.best").alias("score"),
        (F.col("shift") + F.col("s.lo")).cast("long").alias("first_word"),
        (F.col("s.hi") - F.col("s.lo")).cast("long").alias("n_words"),
        F.expr("size(filter(slice(equal, s.lo + 1, s.hi - s.lo), e -> e))").cast("long").alias("n_equal"),
        F.col("item_words").cast("long").alias("item_words"),
    )
    best = F.struct("score", -F.col("first_word"), "n_words", "n_equal", "item_words")
    out = found.groupBy("doc_id", "item_id").agg(F.max(best).alias("b"), F.count("*").alias("n_places"))
    out = out.select(
        "doc_id",
        "item_id",
        F.col("b.score").cast("long").alias("score"),
        (-F.col("b.col2")).alias("first_word"),
        F.col("b.n_words").alias("n_words"),
        F.col("b.n_equal").alias("n_equal"),
        F.col("b.item_words").alias("item_words"),
        "n_places",
    )
    return out if short is None else out.union(short)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns; rows without an id stay."""
    leaked = unused(docs, "_leak_id")
    leaks = materialise(find_leaks(docs, benchmark, id_col, **options).select(F.col("doc_id").alias(leaked)).distinct(), "leak-ids")
    return docs.join(leaks, F.col(id_col).cast("long") == F.col(leaked), "left_anti")
