"""Parameters that change results, with their defaults and validity rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

SOURCES = ("standard", "random")
SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class SplitDates:
    """Inclusive day ranges of the three splits, in order and disjoint."""

    train: tuple[date, date]
    val: tuple[date, date]
    test: tuple[date, date]

    def __post_init__(self) -> None:
        days = [*self.train, *self.val, *self.test]
        if any(getattr(self, s)[0] > getattr(self, s)[1] for s in SPLITS):
            raise ValueError("a split ends before it starts")
        if not (days[1] < days[2] and days[3] < days[4]):
            raise ValueError("splits must be ordered and must not overlap")

    def start(self, split: str) -> date:
        return getattr(self, split)[0]


@dataclass(frozen=True)
class FeatureParams:
    sources: tuple[str, ...] = ("standard",)
    windows: tuple[int, ...] = (3, 7)
    prior_strength: float = 20.0
    # Columns known to be computed after the fact.
    leaky_columns: tuple[str, ...] = (
        "visible_status",
        "show_cnt",
        "show_user_num",
        "play_cnt",
        "play_user_num",
        "play_duration",
        "complete_play_cnt",
        "valid_play_cnt",
        "long_time_play_cnt",
        "like_cnt",
        "click_like_cnt",
        "comment_cnt",
        "share_cnt",
        "follow_cnt",
    )

    def __post_init__(self) -> None:
        if list(self.windows) != sorted(set(self.windows)) or min(self.windows, default=1) < 1:
            raise ValueError("windows must be positive, sorted and unique")


@dataclass(frozen=True)
class BaselineParams:
    """Set a model's entry to None to leave that model out."""

    most_popular: dict | None = field(default_factory=dict)
    recent_popular: dict | None = field(default_factory=lambda: {"window_days": 3})
    item_cooc: dict | None = field(default_factory=dict)
    random: dict | None = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.recent_popular is not None and not self.recent_popular.get("window_days"):
            raise ValueError("recent_popular needs window_days")


@dataclass(frozen=True)
class EvalParams:
    eval_sets: tuple[str, ...] = ("val_standard", "val_random", "test_standard", "test_random")
    labels: tuple[str, ...] = ("is_click", "long_view")
    ks: tuple[int, ...] = (10, 50, 100, 500)
    headline_k: int = 100
    ranking_ks: tuple[int, ...] = (5, 10)
    users: str = "warm"
    exclude_fit_positives: bool = True
    diversity_k: int = 10
    group_by: str = "user"
    gauc_weight: str = "impressions"
    bootstrap_samples: int = 200
    seed: int = 17

    def __post_init__(self) -> None:
        if self.headline_k not in self.ks:
            raise ValueError("headline_k must be one of ks")
        if self.users not in ("warm", "all"):
            raise ValueError("users must be 'warm' or 'all'")
        if self.group_by not in ("user", "user_date"):
            raise ValueError("group_by must be 'user' or 'user_date'")
        if self.gauc_weight not in ("impressions", "uniform"):
            raise ValueError("gauc_weight must be 'impressions' or 'uniform'")


@dataclass(frozen=True)
class TwoTowerParams:
    signal: str = "is_click"
    max_history: int = 50
    max_tags: int = 4
    min_count: int = 1
    id_min_count: int | None = 5
    field_dim: int = 32
    user_field_dim: int = 8
    hidden: int = 256
    dim: int = 64
    temperature: float = 0.05
    history_grad: bool = False
    batch_size: int = 2048
    epochs: int = 2
    lr: float = 0.002
    max_examples: int | None = None
    shard_rows: int = 4_096
    parallel_shards: int = 64
