"""Language identification: averaged embeddings of hashed subwords and a linear softmax, trained by SGD in numpy.

Subwords are runs of 3 and 4 bytes of the lower-cased text, in which everything but letters is one space. A document is the mean of
its subwords' embeddings. Training takes every labelled document as a whole text; a fifth of them is kept apart to calibrate a temperature and the
thresholds below which a prediction is rejected. In a round every task goes on from the same model with its own documents, a few at a time; then
each subword's embedding becomes the mean over the tasks that met it, put together by Spark for a range of subwords at a time.

Thresholds depend on the number of subwords, as short texts score lower. They are taken from the starts, of all lengths, of the texts kept apart:
the lowest score that turns away ``REJECT`` of the negatives (the same starts with their letters shuffled, or with the words of two
languages in turn), but never one that turns away more than ``LOSS`` of the starts themselves. Where no language has a second document
nothing can be kept apart, and only texts without letters are rejected.

After training, embedding and softmax are folded into one table of scores per subword, so that prediction is a mean of table rows.
A null text, or one without letters, is ``und`` with score 0 and rejected. Without any labelled document every text is. Ties go to the
first language in order. Extra columns and repeated rows pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from followgraph.llm.common import settle, small_side
from followgraph.llm.shingles import string_buffers, text_chunks
from followgraph.session import written

_RARE = 50  # documents of a language below which their places decide which are kept apart, not their hashes
SIZES = (3, 4)
BUCKETS = 1 << 16
WIDTH = 16
EPOCHS = 6  # at most; each is a round over all documents
_STEPS = 10_000  # documents that a task should have learnt from in all rounds
_DOCS_PER_TASK = 4_000
_RANGE = 4_096  # buckets that are put together at once
_TEMPERATURES = np.geomspace(0.25, 8, 31)
LOSS = 0.005
REJECT = 0.95
_SHORTEST = 8  # characters of the shortest start; every next one is twice as long, up to the whole text
_LONGEST = 12  # the power of two of the number of subwords from which texts are of one length
UNKNOWN = "und"
_CHUNK = 2 << 20
_AT_ONCE = 1 << 16  # characters whose starts are scored together

_PLAIN = np.full(256, 32, dtype=np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # scores by bucket and language, a row of zeros at the end
    bias: np.ndarray
    temperature: float = 1.0
    thresholds: tuple[float, ...] = (0.0,)  # by the power of two of the number of subwords; the last one for all longer texts


def _has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter; those in which the regular expression finds none, which knows fewer, are looked at again."""
    found = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False).copy()
    for row in np.flatnonzero(~found).tolist():
        found[row] = any(map(str.isalpha, texts[row].as_py() or ""))
    return found


def _subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of the subword at each byte, once per size; ``BUCKETS`` where there is none."""
    data = data[offsets[0] : offsets[-1]]
    plain = _PLAIN[data]
    # capitals of Latin-1 in UTF-8: C3 80-9E, without the sign at 97
    after = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, dtype=np.int64)
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    plain[capital] += 0x20
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for size in SIZES:
        out = np.full(len(plain), BUCKETS, dtype=np.int32)
        n = len(plain) - size + 1
        if n > 0:
            code = np.full(n, size, dtype=np.uint32)
            for k in range(size):
                code = code * np.uint32(0x01000193) ^ plain[k : k + n]
            code = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
            whole = text[:n] == text[size - 1 :]
            two_spaces = (plain[:n] == 32) & (plain[1 : n + 1] == 32)
            out[:n] = np.where(whole & ~two_spaces, code.astype(np.int32), BUCKETS)
        yield out


def _features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, buckets, counts) of every text."""
    data, offsets = string_buffers(texts)
    for low, high in text_chunks(texts, _CHUNK):
        own = offsets[low : high + 1]
        parts = list(_subwords(data, own))
        for row in range(high - low):
            a, b = own[row] - own[0], own[row + 1] - own[0]
            buckets, counts = np.unique(np.concatenate([p[a:b] for p in parts]), return_counts=True)
            yield low + row, buckets[buckets < BUCKETS], counts[buckets < BUCKETS]


def train(docs: DataFrame, eligible: Column, seed: int = 0) -> Model:
    """A model from the rows of ``docs`` that are ``eligible`` and have text and lang."""
    labelled = docs.where(eligible).where("text is not null and lang is not null and doc_id is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(sizes)
    rare = [lang for lang in languages if sizes[lang] < _RARE]
    place = F.xxhash64("doc_id")
    sample = labelled.withColumn("apart", F.pmod(place, F.lit(5)) == 2)
    if rare:  # so that a language with two documents has one on either side
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
        few = labelled.where(F.col("lang").isin(rare)).select("doc_id", "lang").distinct().withColumn("rare_apart", rank % 5 == 2)
        sample = sample.join(small_side(written(few, "rare-languages")), ["doc_id", "lang"], "left")
        sample = sample.withColumn("apart", F.coalesce("rare_apart", "apart")).select("doc_id", "lang", "text", "apart")
    model = _fit(sample.where(~F.col("apart")), languages, sum(sizes.values()), seed)
    model.temperature = _temperature(sample.where("apart"), model)
    model.thresholds = _thresholds(sample.where("apart"), model)
    return model


def _starts(length: int) -> list[int]:
    """Characters of the starts of a text of this length, the last of which is the text."""
    return [min(_SHORTEST << k, length) for k in range(max(0, (length - 1) // _SHORTEST).bit_length() + 1)] if length else []


def _shuffled_starts(text: str, sizes: list[int], seed: int) -> list[str]:
    """Starts of the text with these numbers of characters, each with its letters in random places of letters."""
    signs = np.array(list(text[: max(sizes, default=0)]), dtype="<U1")
    letters = np.flatnonzero(np.strings.isalpha(signs))
    codes, out = signs.view("<u4"), []
    for size in sizes:
        own, at = codes[:size].copy(), letters[: np.searchsorted(letters, size)]
        own[at] = own[np.random.default_rng(seed).permutation(at)]
        out.append(own.tobytes().decode("utf-32-le"))
    return out


def _thresholds(apart: DataFrame, model: Model) -> tuple[float, ...]:
    """Thresholds from (doc_id, lang, text) of the documents kept apart."""
    # in the order of a hash, so that neighbours are of several languages
    starts = apart.select("doc_id", "lang", "text").repartition("doc_id").sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)), "doc_id", "lang")

    def scored(rated: list[str], is_clean: list[bool]) -> pa.RecordBatch:
        chance, count = _chances(pa.array(rated, pa.string()), model)
        score = np.where(count > 0, chance.max(axis=1), np.nan)
        return pa.RecordBatch.from_arrays([pa.array(is_clean), pa.array(_length_class(count)), pa.array(score)], names=["clean", "size", "score"])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, langs, texts = (c.to_pylist() for c in batch.columns)
            others, following, last = [None] * len(docs), None, None
            for k in reversed(range(len(docs))):  # the next text of another language
                if last is not None and langs[k] != langs[last]:
                    following = last
                others[k] = texts[following] if following is not None and langs[following] != langs[k] else None
                last = k
            rated, is_clean, held = [], [], 0
            for doc, text, other in zip(docs, texts, others):
                if not text:
                    continue
                words = [w for pair in zip(text.split(), other.split()) for w in pair] if other else []
                mixed = " ".join(words)
                sizes = _starts(len(text))
                clean = [text[:n] for n in sizes]
                wrong = _shuffled_starts(text, sizes, abs(doc)) + [mixed[:n] for n in _starts(len(mixed))]
                rated += clean + wrong
                is_clean += [True] * len(clean) + [False] * len(wrong)
                held += 3 * len(text)
                if held >= _AT_ONCE:
                    yield scored(rated, is_clean)
                    rated, is_clean, held = [], [], 0
            if rated:
                yield scored(rated, is_clean)

    scores = starts.mapInArrow(rate, "clean boolean, size bigint, score double").where("not isnan(score)")
    share = F.percentile_approx("score", [LOSS, REJECT], 100_000)
    scores = scores.groupBy("size", "clean").agg(share.alias("at")).collect()
    by_size = {(r["size"], r["clean"]): r["at"] for r in scores}
    out = [0.0]
    for size in range(max((k for k, clean in by_size if clean), default=-1) + 1):
        clean, wrong = by_size.get((size, True)), by_size.get((size, False))
        # a length that none of them has takes the threshold of the next shorter one
        limit = clean[0] if clean else out[-1]
        out.append(min(limit, wrong[1]) if clean and wrong else limit)
    return tuple(out[1:] or out)


def _length_class(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(counts, 1)).astype(np.int64).clip(max=_LONGEST)


def _fit(training: DataFrame, languages: list[str], number: int, seed: int) -> Model:
    """Embedding and softmax from (lang, text) of all documents; the driver holds one model."""
    random = np.random.default_rng(seed)
    n = max(1, len(languages))
    table = random.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights = random.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, n))
    bias = np.zeros(n)
    tasks = max(1, number // _DOCS_PER_TASK)
    rounds = min(EPOCHS, max(2, -(-_STEPS * tasks // max(1, number))))
    training = training.select("lang", "text").coalesce(tasks)
    context = training.sparkSession.sparkContext
    for round_ in range(rounds if languages else 0):
        shared = context.broadcast((table, weights, bias))
        learnt = training.mapInArrow(_round_function(shared, languages, 4.0 * (1 - round_ / rounds)), "part int, docs double, seen binary, vectors binary")
        means = learnt.groupBy("part").applyInArrow(_mean_of_part, "part int, seen binary, vectors binary").collect()
        for r in means:  # one row for each range of buckets, and one for the softmax
            values = np.frombuffer(r["vectors"], "<f8")
            if r["part"] < 0:
                weights, bias = values[: weights.size].reshape(weights.shape).copy(), values[weights.size :].copy()
            else:
                table[np.frombuffer(r["seen"], "<i4")] = values.reshape(-1, WIDTH)
        shared.unpersist()
    scores = np.vstack([table @ weights, np.zeros((1, n))]).astype(np.float32)
    return Model(languages, scores, bias)


def _round_function(shared, languages: list[str], rate: float):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        first, weights, bias = (x.copy() for x in shared.value)
        table, met, docs = first, np.zeros(BUCKETS, dtype=bool), 0
        for batch in batches:
            target = pc.index_in(batch.column(0), pa.array(languages)).to_numpy(zero_copy_only=False)
            for row, buckets, counts in _features(batch.column(1)):
                if not len(buckets):
                    continue
                share = counts / counts.sum()
                mean = share @ table[buckets]
                error = _softmax(mean @ weights + bias)
                error[target[row]] -= 1
                back = weights @ error
                weights -= rate * 0.1 * np.outer(mean, error)
                bias -= rate * 0.01 * error
                # a subword's step is scaled by its share, so frequent ones move most
                table[buckets] -= rate * 20 * np.outer(share, back)
                met[buckets] = True
                docs += 1
        if not docs:
            return
        parts = [(-1, b"", np.concatenate([weights.ravel(), bias]).astype("<f8").tobytes())]
        for low in range(0, BUCKETS, _RANGE):
            seen = low + np.flatnonzero(met[low : low + _RANGE])
            if len(seen):
                parts.append((low // _RANGE, seen.astype("<i4").tobytes(), table[seen].astype("<f4").tobytes()))
        for part, seen, vectors in parts:
            columns = [pa.array([part], pa.int32()), pa.array([float(docs)]), pa.array([seen], pa.binary()), pa.array([vectors], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "docs", "seen", "vectors"])

    return learn


def _mean_of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean over the tasks, by their documents: of the softmax, or of each bucket's embedding over those that met it."""
    part, total, weight, docs = None, 0.0, np.zeros(_RANGE), 0.0
    for batch in batches:
        for part, own, seen, vectors in zip(*(c.to_pylist() for c in batch.select(["part", "docs", "seen", "vectors"]).columns)):
            docs += own
            if part < 0:
                total = total + own * np.frombuffer(vectors, "<f8")
                continue
            at = np.frombuffer(seen, "<i4") - part * _RANGE
            if np.isscalar(total):
                total = np.zeros((_RANGE, WIDTH))
            total[at] += own * np.frombuffer(vectors, "<f4").reshape(-1, WIDTH).astype(np.float64)
            weight[at] += own
    if part is None:
        return
    at = np.flatnonzero(weight)
    mean = total / docs if part < 0 else total[at] / weight[at, None]
    columns = [pa.array([part], pa.int32()), pa.array([(at + part * _RANGE).astype("<i4").tobytes()], pa.binary()), pa.array([mean.astype("<f8").tobytes()], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["part", "seen", "vectors"])


def _temperature(apart: DataFrame, model: Model) -> float:
    """The temperature with the smallest loss over the documents kept apart; a task returns one sum for each."""

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(_TEMPERATURES))
        for batch in batches:
            target = pc.index_in(batch.column(0), pa.array(model.languages)).to_numpy(zero_copy_only=False)
            chance, count = _chances(batch.column(1), model)
            logits, target = np.log(np.maximum(chance[count > 0], 1e-300)), target[count > 0]
            for k, t in enumerate(_TEMPERATURES):
                total[k] -= np.log(_softmax(logits / t)[np.arange(len(target)), target] + 1e-12).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "loss"])

    summed = apart.select("lang", "text").mapInArrow(losses, "k bigint, loss double").groupBy("k").agg(F.sum("loss").alias("loss"))
    best = min(summed.collect(), key=lambda r: (r["loss"], r["k"]), default=None)
    return float(_TEMPERATURES[best["k"]]) if best and best["loss"] > 0 else 1.0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _chances(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated chance of each language, and number of subwords, of every text."""
    n = max(1, len(model.languages))
    columns = np.ascontiguousarray(model.table.T)
    data, offsets = string_buffers(texts)
    logits, counts = np.zeros((len(texts), n)), np.zeros(len(texts))
    for low, high in text_chunks(texts, _CHUNK):
        own = offsets[low : high + 1]
        filled = np.flatnonzero(np.diff(own))
        starts = (own[:-1] - own[0])[filled]
        total, count = np.zeros((len(filled), n)), np.zeros(len(filled))
        for buckets in _subwords(data, own) if len(filled) else ():
            count += np.add.reduceat((buckets < BUCKETS).astype(np.int64), starts)
            for k in range(n):
                total[:, k] += np.add.reduceat(columns[k].take(buckets), starts, dtype=np.float64)
        logits[low + filled] = total / np.maximum(count, 1)[:, None] + model.bias
        counts[low + filled] = count
    return _softmax(logits / model.temperature), counts


def predict(docs: DataFrame, model: Model, only_kept: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` (und without letters), ``score`` (calibrated, 0 to 1) and ``rejected``.

    ``only_kept`` leaves the rejected rows out in the workers. Texts are worked on and passed on a few MB at a time.
    """
    docs = docs.drop("lang_pred", "score", "rejected")  # replaced
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.columns
    at = kept.index("text")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        model = shared.value
        thresholds = np.array(model.thresholds)
        for batch in batches:
            for low, high in text_chunks(batch.column(at), _CHUNK):
                part = batch.slice(low, high - low)
                texts = part.column(at)
                chance, count = _chances(texts, model)
                best = chance.argmax(axis=1)
                known = _has_letter(texts) & bool(model.languages)
                score = np.where(known, chance[np.arange(len(best)), best], 0.0)
                below = score < thresholds[np.minimum(_length_class(count), len(thresholds) - 1)]
                pred = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                columns = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(~known | below)]
                rows = pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*kept, "lang_pred", "score", "rejected"])
                yield rows.filter(pc.invert(columns[2])) if only_kept else rows

    added = T.StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.mapInArrow(rate, T.StructType(docs.schema.fields + added.fields))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that a model must not learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents, learnt from those that aren't held out."""
    model = train(docs, ~held_out())
    kept = docs.columns
    # columns of the same names as the prediction's are put aside meanwhile
    aside = docs.select(*[F.col(f"`{c}`").alias(f"_{k}" if c != "text" else c) for k, c in enumerate(kept)])
    rows = predict(aside, model, only_kept=True)
    return rows.select(*[F.col(f"_{k}" if c != "text" else c).alias(c) for k, c in enumerate(kept)])
