"""Batch model scoring and rate analytics on Spark DataFrames."""

from veritally.operators.rates import label_summary, rate_by, rates_by_all, score_summary, top_groups
from veritally.operators.replicate import replicate, scale_family, union_by_name, weigh_each
from veritally.operators.scoring import get_scorer, register_scorer, register_sql, score
from veritally.plans.identity import IdentityTables
from veritally.sources.bucketed import BucketedTables
from veritally.sources.store import ScoreStore
from veritally.sources.tables import conform, read_csv, read_parquet, register_views

__all__ = [
    "BucketedTables",
    "IdentityTables",
    "ScoreStore",
    "conform",
    "get_scorer",
    "label_summary",
    "rate_by",
    "rates_by_all",
    "read_csv",
    "read_parquet",
    "register_scorer",
    "register_sql",
    "register_views",
    "replicate",
    "scale_family",
    "score",
    "score_summary",
    "top_groups",
    "union_by_name",
    "weigh_each",
]
