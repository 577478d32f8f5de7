"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Texts are lower-cased and split at everything but letters and digits. A seed hashes the words of a window at the places of a
fixed mask and ignores the others, so that replaced words at ignored places don't hide a hit. Hits of documents and
benchmark items with the same distance between their places lie on one diagonal; around each the two texts are compared word by word.
An item counts as contained if at least ``PERCENT`` of its words stand at their places, or if some stretch has a score of ``SCORE`` or
more, where an equal word gives 1 and a replaced one costs 2.

Nulls and empty texts hit nothing. Items with fewer words than a mask (``SPAN``) are not looked for: such
phrases stand in any text. Rows without ``doc_id`` or ``item_id`` take no part. Repeated rows give one result. Ties go to the smallest start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from followgraph.llm.common import small_side
from followgraph.session import written

MASKS = ("110110011", "101101101")
SPAN = 9
PERCENT = 75
SCORE = 12


def _words(text: Column) -> Column:
    """Words of a text; none for null."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _seeds(rows: DataFrame, key: str) -> DataFrame:
    """(key, seed, at) of every window and mask of the text."""

    def masked(h: Column, number: int, mask: str) -> Column:
        places = [k for k, c in enumerate(mask) if c == "1"]
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - SPAN), lambda i: F.xxhash64(F.lit(number), *[F.get(h, i + p) for p in places])
        )

    def windows(h: Column) -> Column:
        return F.when(F.size(h) >= SPAN, F.concat(*[masked(h, *m) for m in enumerate(MASKS)])).otherwise(F.array().cast("array<bigint>"))

    # a lambda holds the words' hashes, so that they are computed once for a text and not once for each window
    hashes = F.transform(_words(F.col("text")), lambda w: F.xxhash64(w))
    seeds = rows.select(key, F.get(F.transform(F.array(hashes), windows), 0).alias("s"))
    places = seeds.select(key, F.size("s").alias("n"), F.posexplode("s").alias("at", "seed"))
    return places.select(key, "seed", F.expr(f"at % (n div {len(MASKS)})").cast("int").alias("at"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, item_words, matched, score): the best place of each benchmark item in each document that has it.

    ``start`` is the place of the item's first word among the document's words (negative if the document begins inside the item).
    """
    items = benchmark.where("item_id is not null").select("item_id", "text").distinct()
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    seeds = written(_seeds(items, "item_id").withColumnRenamed("at", "item_at").distinct(), "seeds")
    hits = _seeds(texts, "doc_id").join(small_side(seeds, 32), "seed")
    diagonals = hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("start")).distinct()
    diagonals = written(diagonals, "diagonals")
    with_hits = small_side(written(diagonals.select("doc_id").distinct(), "hit-docs"))
    words = texts.join(with_hits, "doc_id", "left_semi").select("doc_id", _words(F.col("text")).alias("words"))
    item_words = items.select("item_id", _words(F.col("text")).alias("item"))
    # only the words beside a hit go on, not the whole document once for each hit
    pairs = words.join(diagonals.join(item_words, "item_id"), "doc_id")
    size = F.size("item")
    first = F.greatest(F.lit(0), -F.col("start"))
    length = F.least(size, F.size("words") - F.col("start")) - first
    here = F.slice("words", F.col("start") + first + 1, length)
    there = F.slice("item", first + 1, length)
    aligned = pairs.where(length > 0).select(
        "doc_id", "item_id", "start", size.alias("item_words"), F.zip_with(here, there, lambda x, y: x == y).alias("equal")
    )
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(state: Column, same: Column) -> Column:
        now = F.greatest(F.lit(0), state["now"] + F.when(same, 1).otherwise(-2))
        return F.struct(now.alias("now"), F.greatest(state["best"], now).alias("best"))

    scored = aligned.select(
        "doc_id", "item_id", "start", "item_words",
        F.size(F.filter("equal", lambda same: same)).alias("matched"),
        F.aggregate("equal", zero, step, lambda state: state["best"]).alias("score"),
    )
    found = scored.where((100 * F.col("matched") >= PERCENT * F.col("item_words")) | (F.col("score") >= SCORE))
    best = F.max(F.struct("matched", "score", (-F.col("start")).alias("back"), "item_words"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", (-F.col("b.back")).alias("start"), F.col("b.item_words").alias("item_words"),
        F.col("b.matched").alias("matched"), F.col("b.score").alias("score"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; rows without doc_id stay."""
    gone = written(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(small_side(gone), "doc_id", "left_anti").select(*docs.columns)
