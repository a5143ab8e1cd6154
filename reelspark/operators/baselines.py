"""The baseline models a set of parameters enables."""

from __future__ import annotations

from reelspark.operators.cooccurrence import ItemCooccurrence
from reelspark.operators.popularity import MostPopular
from reelspark.operators.random_ranker import RandomRecommender
from reelspark.operators.recommend import Recommender
from reelspark.params import BaselineParams


def build_baselines(params: BaselineParams | None = None, seed: int = 17) -> list[Recommender]:
    """Unfitted models; an entry set to None is left out."""
    params = params or BaselineParams()
    models: list[Recommender] = []
    if params.most_popular is not None:
        models.append(MostPopular(**params.most_popular))
    if params.recent_popular is not None:
        models.append(MostPopular(**params.recent_popular))
    if params.item_cooc is not None:
        models.append(ItemCooccurrence(**params.item_cooc))
    if params.random is not None:
        models.append(RandomRecommender(seed=seed, **params.random))
    return models
