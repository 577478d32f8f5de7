"""Spelling variants: words of a corpus grouped by one inserted, deleted or replaced code point.

Words that may be near each other are brought together by parts that must be equal: of two words that differ by one edit, either the first or the last
half is the same in both. A word goes to the groups of its halves, for its own length and the lengths next to it. A group with
more than ``_GROUP`` words is divided again by the same argument for what its words don't share yet, so no group grows with the vocabulary. Groups are dealt
to buckets of bounded size; each bucket is one bidirectional FM-index over its delimited words, and a search scheme finds all near words:
a half is matched exactly, then extended across the other half with one error.

Texts are counted whole, in parts of bounded size. Null and empty texts have no words; documents without ``doc_id`` count with an empty id;
repeated rows count as often as they come; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from followgraph.llm.common import release, small_side
from followgraph.llm.fm_index import WordIndex
from followgraph.session import written

MIN_LENGTH = 5
MIN_COUNT = 3
_RUN = re.compile("[a-zÀ-ÿ]+")
_REST_OF_RUN = re.compile("[A-Za-zÀ-ÿ]*")
_DAMAGED = 97  # one of so many runs loses a code point
_PART = 4 << 20  # code points of a text that are counted at once
_HELD = 400_000  # different words that a task holds
_BUCKET = 20_000  # words of an index
_GROUP = 2_000  # words of a group beyond which it is divided


def _parts(text: str) -> Iterator[str]:
    """The text in parts that end between words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + _PART)
        end = _REST_OF_RUN.match(text, end).end()
        yield text[at:end]
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts with their occurrences.

    A word is a run of letters with A-Z in lower case; in a document with the id d, a run r whose crc32 of ``d:r`` is divisible by 97 loses
    its code point at that number modulo its length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = batch.column(0)
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if ids[row].as_py() is None else ids[row].as_py()}:".encode())
                for part in _parts(text):
                    # lower() of bytes is that of A-Z
                    for run, n in Counter(_RUN.findall(part.encode().lower().decode())).items():
                        code = zlib.crc32(run.encode(), seed)
                        if code % _DAMAGED == 0:
                            at = code % len(run)
                            run = run[:at] + run[at + 1 :]
                        if len(run) >= MIN_LENGTH:
                            held[run] += n
                    if len(held) >= _HELD:
                        yield rows()
                        held.clear()
        if held:
            yield rows()

    rows = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _routes(words: DataFrame) -> DataFrame:
    """(word, n, own, side, target, front, back, key): the groups in which each word is searched, and indexed where ``own``.

    A group holds the indexed words of the length ``target`` with the same first ``front`` and last ``back`` code points. ``side`` tells which half
    of a pair is equal: 0 the first, 1 the last.
    """
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length - 1, length, length + 1)).alias("target"))
    rows = rows.where(f"target >= {MIN_LENGTH}").withColumn("own", length == F.col("target"))
    rows = rows.select("*", F.lit(0).alias("front"), F.lit(0).alias("back"))
    rows, done = _divided(rows, None), None
    while True:
        rows = written(rows, "routes")
        large = rows.where("own and target - front - back > 2").groupBy("key").count().where(f"count > {_GROUP}").select("key")
        large = written(large, "large-groups")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        large = small_side(large, 16)
        rest = rows.join(large, "key", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        rows = _divided(rows.join(large, "key", "left_semi"), "side")


def _divided(rows: DataFrame, side: str | None) -> DataFrame:
    """Each group as two: what its words don't share yet is equal in its first half, or in its last half."""
    share = F.floor((F.col("target") - F.col("front") - F.col("back") - 1) / 2).cast("int")
    first = F.struct((F.col("front") + share).alias("front"), F.col("back").alias("back"), F.lit(0).alias("half"))
    last = F.struct(F.col("front").alias("front"), (F.col("back") + share).alias("back"), F.lit(1).alias("half"))
    rows = rows.withColumn("d", F.explode(F.array(first, last)))
    kept = F.col(side) if side else F.col("d.half")
    rows = rows.select("word", "n", "own", kept.alias("side"), "target", F.col("d.front").alias("front"), F.col("d.back").alias("back"))
    shared = [F.expr("substring(word, 1, front)"), F.expr("if(back = 0, '', right(word, back))")]
    return rows.withColumn("key", F.xxhash64("side", "target", "front", "back", *shared))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words that differ by one code point, both ways.

    ``words`` (word, n) is a written table of distinct words of at least ``MIN_LENGTH`` code points.
    """
    routes = _routes(words)
    buckets = max(1, -(-4 * words.count() // _BUCKET))
    rows = routes.select("word", "n", "own", "side", F.expr(f"pmod(key, {buckets})").alias("bucket"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["own"]].drop_duplicates("word")
        found = [pd.DataFrame({"word": [], "n": [], "near": [], "near_n": []}).astype({"n": "int64", "near_n": "int64"})]
        if len(own):
            index = WordIndex(own["word"].tolist())
            for side, some in rows.groupby("side"):
                some = some.drop_duplicates("word")
                pattern, word = index.one_edit(some["word"].tolist(), side == 0)
                some, other = some.iloc[pattern], own.iloc[word]
                pairs = {"word": some["word"].values, "n": some["n"].values, "near": other["word"].values, "near_n": other["n"].values}
                found.append(pd.DataFrame(pairs))
        return pd.concat(found).drop_duplicates(["word", "near"])

    found = rows.groupBy("bucket").applyInPandas(search, "word string, n bigint, near string, near_n bigint")
    return found.repartition("word").dropDuplicates(["word", "near"])


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms lead in the end. Every round doubles the steps; counts double with each step, so there are few."""
    pointers = written(forms.select("word", F.col("form").alias("to")), "pointers")
    while True:
        further = pointers.select(F.col("word").alias("to"), F.col("to").alias("next"))
        step = written(pointers.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to"), "next"), "pointers")
        release(pointers)
        pointers = step.select("word", "to")
        if step.where("next is not null").isEmpty():
            return pointers.withColumnRenamed("to", "root")


def variants(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every frequent word with its usual form.

    The form is the most frequent near word (ties: the first in code-point order) if it is at least twice as frequent.
    """
    words = written(word_counts(docs).where(F.col("n") >= min_count), "words")
    none = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("bigint").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct(-F.col("near_n"), F.col("near"))))
    by_word = none.unionByName(near_words(words)).groupBy("word").agg(
        F.first("n").alias("n"), F.count("near").alias("n_near"), best.alias("best")
    )
    known = -F.col("best.col1") >= 2 * F.col("n")
    by_word = by_word.select(
        "word", "n", "n_near", F.when(known, F.col("best.near")).alias("form"), F.when(known, -F.col("best.col1")).alias("form_n")
    )
    by_word = written(by_word, "word-forms")
    rows = by_word.join(_roots(by_word.where("form is not null")), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
