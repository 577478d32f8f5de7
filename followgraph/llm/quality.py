"""Quality classifier by co-training: a content view and a metadata view teach each other.

The content view sees hashed words and word pairs of the whole text, the metadata view source, language and the size of ``n_chars``. Both are logistic
models trained by SGD in numpy. In each round either model labels the unlabelled documents of which it is surest for the other one. At
the end the two are calibrated and combined on labelled documents that neither has learnt from.

Training takes at most ``PER_CLASS`` labelled documents a class and ``POOL`` unlabelled ones, those with the smallest hashes of doc_id, as
whole texts; all documents are scored. Null and empty texts have no content features and are judged by metadata; null metadata is a
value of its own. Without labels of both classes every score is 0.5. Of several labels of a document the smallest counts. Repeated
rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from followgraph.llm.common import small_side
from followgraph.llm.shingles import mixed, string_buffers, text_chunks, word_hashes
from followgraph.session import written

PER_CLASS = 1500
POOL = 2000
ROUNDS = 3
SHARED = 100  # pseudo-labels of each class that a model hands over in a round
CONFIDENT = 0.9
BUCKETS = 1 << 16
EPOCHS = 5


@dataclass
class Model:
    content: np.ndarray
    metadata: np.ndarray
    #: per view: logit = scale * raw + shift; then their weights and the common shift
    calibration: np.ndarray = field(default_factory=lambda: np.array([[1.0, 0.0], [1.0, 0.0]]))
    combined: np.ndarray = field(default_factory=lambda: np.zeros(3))


def _content(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and normalised values of each text; the last bucket is the constant."""
    data, offsets = string_buffers(texts)
    for low, high in text_chunks(texts):
        words, firsts, _ = word_hashes(data, offsets[low : high + 1])
        pairs = mixed(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]
        for row in range(high - low):
            a, b = firsts[row], firsts[row + 1]
            keys = np.concatenate([words[a:b], pairs[a : max(a, b - 1)]]) % np.uint64(BUCKETS)
            buckets, counts = np.unique(keys.astype(np.int64), return_counts=True)
            values = np.log1p(counts)
            values /= max(1e-9, np.sqrt((values**2).sum()))
            yield np.append(buckets, BUCKETS), np.append(values, 1.0)


def _metadata(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for source, lang, n_chars in rows:
        size = -1 if n_chars is None or n_chars < 0 else int(n_chars).bit_length()
        names = [f"source={source}", f"lang={lang}", f"size={size}", f"{source}|{lang}"]
        buckets = [_named(n) for n in names]
        yield np.array([*buckets, BUCKETS]), np.array([0.5] * len(names) + [1.0])


def _named(name: str) -> int:
    number = np.uint64(0)
    for byte in name.encode():
        number = mixed(np.array([number + np.uint64(byte + 1)], dtype=np.uint64))[0]
    return int(number % np.uint64(BUCKETS))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _learn(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, seed: int) -> np.ndarray:
    random, weights = np.random.default_rng(seed), np.zeros(BUCKETS + 1)
    for epoch in range(EPOCHS):
        rate = 2.0 / (1 + epoch)
        for k in random.permutation(len(rows)):
            buckets, values = rows[k]
            step = rate * (target[k] - _sigmoid(weights[buckets] @ values))
            np.add.at(weights, buckets, step * values)
    return weights


def _raw(weights: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.array([weights[b] @ v for b, v in rows], dtype=np.float64)


def _platt(features: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of a logistic fit on few columns, by damped Newton steps."""
    x = np.column_stack([features, np.ones(len(target))])
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ weights)
        slope = x.T @ (target - p) - 0.01 * weights
        weights += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.01 * np.eye(x.shape[1]), slope)
    return weights


def train(docs: DataFrame, labels: DataFrame, seed: int = 0) -> Model:
    """Two views trained on the labelled documents and on each other's confident labels."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("y"))
    # bounded sides: the documents with the smallest hashes of each class, and of those without label
    marked = docs.where("doc_id is not null").select("doc_id").distinct().join(known, "doc_id", "left").withColumn("y", F.coalesce("y", F.lit(-1)))
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = marked.withColumn("r", rank).where((F.col("r") <= PER_CLASS) | (F.col("y") < 0) & (F.col("r") <= POOL))
    chosen = written(chosen.select("doc_id", "y"), "training-ids")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(b.astype("<i4").tobytes(), v.astype("<f4").tobytes()) for b, v in _content(batch.column(1))]
            columns = [pa.array([p[k] for p in parts], pa.binary()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *columns], names=names)

    names = ["doc_id", "source", "lang", "n_chars", "y", "buckets", "values"]
    sample = docs.select("doc_id", "text", "source", "lang", "n_chars").join(small_side(chosen), "doc_id")
    schema = "doc_id bigint, source string, lang string, n_chars bigint, y int, buckets binary, values binary"
    # at most 2 PER_CLASS + POOL documents with BUCKETS numbers each
    rows = sample.mapInArrow(features, schema).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * PER_CLASS + POOL).collect()
    return _co_train(rows, seed)


def _co_train(rows: list, seed: int) -> Model:
    views = [
        [(np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["values"], "<f4").astype(np.float64)) for r in rows],
        list(_metadata([(r["source"], r["lang"], r["n_chars"]) for r in rows])),
    ]
    y = np.array([r["y"] for r in rows], dtype=np.int64)
    labelled, pool = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
    if len(np.unique(y[labelled])) < 2:
        return Model(np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1))
    held, taught = labelled[::5], np.setdiff1d(labelled, labelled[::5])
    own = [list(zip(taught, y[taught])), list(zip(taught, y[taught]))]
    used = [set(), set()]
    weights = [None, None]
    for turn in range(ROUNDS + 1):
        for v in (0, 1):
            weights[v] = _learn([views[v][k] for k, _ in own[v]], np.array([t for _, t in own[v]]), seed + turn)
        if turn == ROUNDS or not len(pool):
            break
        for v in (0, 1):
            chance = _sigmoid(_raw(weights[v], [views[v][k] for k in pool]))
            for label, sure in ((1, chance), (0, 1 - chance)):
                order = [k for k in np.argsort(-sure, kind="stable") if sure[k] >= CONFIDENT and pool[k] not in used[v]][:SHARED]
                own[1 - v] += [(pool[k], label) for k in order]
                used[v].update(pool[k] for k in order)
    model = Model(*weights)
    if len(np.unique(y[held])) == 2:
        truth = y[held].astype(np.float64)
        raw = [_raw(weights[v], [views[v][k] for k in held]) for v in (0, 1)]
        model.calibration = np.array([_platt(r[:, None], truth) for r in raw])
        logits = np.column_stack([c[0] * r + c[1] for c, r in zip(model.calibration, raw)])
        model.combined = _platt(logits, truth)
    else:
        model.combined = np.array([0.5, 0.5, 0.0])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, content_score, metadata_score, score, quality_pred) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "content_score", "metadata_score", "score", "quality_pred"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            content = np.array([model.content[b] @ v for b, v in _content(batch.column(1))], dtype=np.float64)
            meta = list(zip(*[batch.column(k).to_pylist() for k in (2, 3, 4)]))
            seen: dict[tuple, float] = {}
            for row, (buckets, values) in zip(set(meta), _metadata(list(set(meta)))):
                seen[row] = float(model.metadata[buckets] @ values)
            metadata = np.array([seen[m] for m in meta], dtype=np.float64)
            a, b = (c[0] * r + c[1] for c, r in zip(model.calibration, (content, metadata)))
            both = _sigmoid(model.combined[0] * a + model.combined[1] * b + model.combined[2])
            columns = [batch.column(0), pa.array(_sigmoid(a)), pa.array(_sigmoid(b)), pa.array(both), pa.array((both >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", "source", "lang", F.col("n_chars").cast("bigint"))
    return rows.mapInArrow(rate, "doc_id bigint, content_score double, metadata_score double, score double, quality_pred int")
