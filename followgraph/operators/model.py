"""Implicit-feedback factors: training, tuning, prediction, export."""

from __future__ import annotations

import itertools
import math
import threading
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from followgraph import fixed
from followgraph.operators import evaluation
from followgraph.operators.bounds import bounded_products, pays
from followgraph.operators.tiles import best_products
from followgraph.session import work_folder, written

_EDGES_PER_BLOCK = 5_000_000
_MIN_BLOCKS = 10
_SWEEP_SECONDS = 15


def als(**settings: object) -> ALS:
    """ALS over (follower_id, artist_id, count); ``settings`` override the live model's."""
    return ALS(
        userCol="follower_id",
        itemCol="artist_id",
        ratingCol="count",
        coldStartStrategy="drop",
        **{**fixed.ALS_SETTINGS, **settings},
    )


def _blocks(ratings: DataFrame) -> dict[str, int]:
    """Blocks of factors; with many edges an iteration is cut off from those before it, so that their shuffles needn't be kept."""
    edges = ratings.count()
    blocks = max(_MIN_BLOCKS, math.ceil(edges / _EDGES_PER_BLOCK))
    return {"numUserBlocks": blocks, "numItemBlocks": blocks, **({"checkpointInterval": 1} if edges > _EDGES_PER_BLOCK else {})}


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Have the driver look every few seconds for what nobody refers to any more: only then does Spark delete the shuffles of iterations and fits that are over."""
    ended = threading.Event()

    def sweep() -> None:
        while not ended.wait(_SWEEP_SECONDS):
            spark._jvm.System.gc()

    sweeper = threading.Thread(target=sweep, daemon=True)
    sweeper.start()
    try:
        yield
    finally:
        ended.set()
        sweeper.join()


def fit(edges: DataFrame, **settings: object) -> ALSModel:
    """Train on ``edges``, cached during the fit only.

    The number of factor blocks grows with the edges unless the settings name it.
    """
    work_folder(edges.sparkSession)  # long trainings checkpoint their factors there
    ratings = edges.select("follower_id", "artist_id", "count").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with _swept(edges.sparkSession):
            return als(**{**_blocks(ratings), **settings}).fit(ratings)
    finally:
        ratings.unpersist()


def item_factors(model: ALSModel, artist_ids: DataFrame) -> DataFrame:
    """Item factors with the alias each id stood for in this training.

    Ids are positions in the alias list of one training and shift when an artist is added, so factors
    are only ever stored together with their alias.
    """
    return model.itemFactors.join(artist_ids, F.col("id") == F.col("artist_id")).select(
        "id", "artist_alias", "features"
    )


def predict(model: ALSModel, pairs: DataFrame) -> DataFrame:
    """Predicted preference of (follower, artist) pairs, highest first; pairs with unseen ids drop out."""
    return (
        model.transform(pairs)
        .where(F.col("prediction").isNotNull() & ~F.isnan("prediction"))
        .orderBy(F.desc("prediction"), "follower_id", "artist_id")
    )


def recommend_artists(model: ALSModel, n: int, followers: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(follower_id, rank, artist_id, prediction): the ``n`` highest predictions per follower, or per
    follower of the given ``follower_id`` table; equal predictions are ordered by artist. The edges of ``known`` (follower_id, artist_id) are no answers.
    """
    # written once each: the tiles read both sides several times, and a lost executor would mean training again
    users = written(model.userFactors, "user-factors")
    if followers is not None:
        users = users.join(followers.select(F.col("follower_id").alias("id")).distinct(), "id", "left_semi")
    pairs = None if known is None else known.select(F.col("follower_id").alias("row_id"), F.col("artist_id").alias("column_id"))
    items = written(model.itemFactors, "item-factors")
    best = bounded_products if pays(users, items) else best_products
    return best(users, items, n, left_out=pairs).select(
        F.col("row_id").cast("int").alias("follower_id"),
        "rank",
        F.col("column_id").cast("int").alias("artist_id"),
        F.col("score").alias("prediction"),
    )


def pair_place(seed: int = fixed.SPLIT_SEED) -> Column:
    """A number from 0 up to 1 for each pair of aliases: that of an edge is the same whatever other edges there are."""
    key = F.concat_ws("|", F.lit(seed).cast("string"), "artist_alias", "follower_alias")
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def split(edges: DataFrame, weights: Sequence[float] = tuple(fixed.SPLIT_WEIGHTS), seed: int = fixed.SPLIT_SEED) -> list[DataFrame]:
    """Parts of the edges by a hash of the pair of aliases, so that an edge is in the same part whatever else is there."""
    place = pair_place(seed)
    ends = list(itertools.accumulate(w / sum(weights) for w in weights))[:-1]
    bounds = [0.0, *ends, 1.0]
    return [edges.where((place >= low) & (place < high)) for low, high in zip(bounds, bounds[1:])]


def with_fold(edges: DataFrame, folds: int, seed: int = fixed.SPLIT_SEED) -> DataFrame:
    """``edges`` with an integer ``fold`` from 0, by the same hash: a repeated search compares the same folds."""
    return edges.withColumn("fold", F.floor(pair_place(seed) * folds).cast("int"))


def rmse_evaluator() -> RegressionEvaluator:
    return RegressionEvaluator(metricName="rmse", labelCol="count", predictionCol="prediction")


def fits_at_once(blocks: int, cores: int) -> int:
    """Enough fits to occupy the cores twice, as a fit has only ``blocks`` tasks at a time; one where its blocks do that alone, so that no more edges are kept at once."""
    return max(1, math.ceil(2 * cores / blocks))


def grid_search(
    training: DataFrame,
    ranks: Sequence[int] = tuple(fixed.GRID_RANKS),
    reg_params: Sequence[float] = tuple(fixed.GRID_REG_PARAMS),
    folds: int = 3,
    seed: int = fixed.SPLIT_SEED,
    parallelism: int | None = None,
    fold_column: str | None = None,
    **settings: object,
) -> CrossValidatorModel:
    """Cross-validate rank x regParam by rmse; the settings are those of ``als``.

    ``fold_column`` names the folds that the edges come with (``with_fold``); without it they are drawn at random. ``parallelism`` fits of a fold run at a time, by
    default as many as ``fits_at_once`` tells.
    """
    work_folder(training.sparkSession)
    own = [fold_column] if fold_column else []
    ratings = training.select("follower_id", "artist_id", "count", *own).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        estimator = als(**{**_blocks(ratings), **settings})
        blocks = max(estimator.getNumUserBlocks(), estimator.getNumItemBlocks())
        grid = ParamGridBuilder().addGrid(estimator.rank, list(ranks)).addGrid(estimator.regParam, list(reg_params)).build()
        search = CrossValidator(
            estimator=estimator,
            estimatorParamMaps=grid,
            evaluator=rmse_evaluator(),
            numFolds=folds,
            seed=seed,
            parallelism=parallelism or fits_at_once(blocks, training.sparkSession.sparkContext.defaultParallelism),
            foldCol=fold_column or "",
        )
        with _swept(training.sparkSession):
            return search.fit(ratings)
    finally:
        ratings.unpersist()


def grid_results(search: CrossValidatorModel) -> list[dict[str, float]]:
    """One entry per grid setting: its parameters, mean rmse, and whether it won."""
    results = []
    for params, metric in zip(search.getEstimatorParamMaps(), search.avgMetrics):
        results.append({**{p.name: v for p, v in params.items()}, "rmse": float(metric)})
    if any(math.isnan(r["rmse"]) for r in results):
        raise ValueError("a setting has no rmse: a fold holds no pair with known ids")
    best = min(range(len(results)), key=lambda i: results[i]["rmse"])
    return [{**r, "best": i == best} for i, r in enumerate(results)]


def best_parameters(search: CrossValidatorModel) -> dict[str, float]:
    """Rank and regParam of the winning setting."""
    winner = next(r for r in grid_results(search) if r["best"])
    return {"rank": winner["rank"], "regParam": winner["regParam"]}


@dataclass(frozen=True)
class RankedSetting:
    """Mean ranking metrics of one grid setting over all folds."""

    rank: int
    regParam: float
    folds: int
    followers: int
    precision: float
    recall: float
    ndcg: float
    average_precision: float
    best: bool = False


def ranked_search(
    edges: DataFrame,
    n: int,
    folds: int = 3,
    ranks: Sequence[int] = tuple(fixed.GRID_RANKS),
    reg_params: Sequence[float] = tuple(fixed.GRID_REG_PARAMS),
    metric: str = "ndcg",
    **settings: object,
) -> list[RankedSetting]:
    """Every rank x regParam by how well its ``n`` recommendations meet held-out edges; the best by ``metric`` (ties: the first) is marked.

    ``edges`` (with aliases, as from ``training_edges``) is cut into folds by ``with_fold``. A follower's known edges of the other folds are no
    answer to the question, so they are left out (``recommend_unknown``). Each fold is trained apart, one after the other, and only means come to the driver.
    """
    work_folder(edges.sparkSession)
    cut = written(with_fold(edges, folds).select("follower_id", "artist_id", "count", "fold"), "folds")
    found: dict[tuple[int, float], list] = {}
    for fold in range(folds):
        known, held = cut.where(F.col("fold") != fold), cut.where(F.col("fold") == fold)
        blocks = _blocks(known)
        for rank, reg in itertools.product(ranks, reg_params):
            fitted = fit(known, **{**blocks, **settings, "rank": rank, "regParam": reg})
            wanted = evaluation.ranking_metrics(recommend_unknown(fitted, known, n), known_ends(fitted, held), n)
            found.setdefault((rank, reg), []).append(evaluation.mean_metrics(wanted).head())
    results = []
    for (rank, reg), rows in found.items():
        followers = sum(r["followers"] for r in rows)
        mean = lambda c: sum(r["followers"] * (r[c] or 0.0) for r in rows) / max(1, followers)  # noqa: B023, E731
        metrics = {c: mean(c) for c in ("precision", "recall", "ndcg", "average_precision")}
        results.append(RankedSetting(rank, reg, len(rows), followers, **metrics))
    top = max(range(len(results)), key=lambda i: getattr(results[i], metric))
    return [replace(r, best=i == top) for i, r in enumerate(results)]


def known_ends(model: ALSModel, edges: DataFrame) -> DataFrame:
    """The edges whose follower and artist both have factors."""
    users = model.userFactors.select(F.col("id").alias("follower_id"))
    items = model.itemFactors.select(F.col("id").alias("artist_id"))
    return edges.join(users, "follower_id", "left_semi").join(items, "artist_id", "left_semi")


def recommend_unknown(model: ALSModel, known: DataFrame, n: int) -> DataFrame:
    """(follower_id, rank, artist_id, prediction): the ``n`` best artists of every follower that it doesn't follow yet.

    The known edges travel with their followers and are left out where the products are compared, so no list is longer than ``n``, however many artists a
    follower follows.
    """
    edges = known.select("follower_id", "artist_id").distinct()
    return recommend_artists(model, n, edges, edges)
