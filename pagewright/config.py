"""Settings from the session, else from the environment, else defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "pagewright"


@dataclass(frozen=True)
class Settings:
    """Each field is spark.pagewright.<name> of the session, else PAGEWRIGHT_<NAME> of the environment. root is the folder of the
    tables, shared by driver and executors."""

    root: str = ""
    embedding_model: str = "hashing"
    vision_model: str = ""
    summary_model: str = ""
    split_model: str = ""
    default_top_k: int = 10
    rrf_k: int = 60
    vision_concurrency: int = 5
    summary_concurrency: int = 5
    model_attempts: int = 1
    enable_concept_split: bool = True

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        found = {}
        for f in fields(cls):
            text = spark.conf.get(f"spark.{PREFIX}.{f.name}", None) or os.environ.get(f"{PREFIX}_{f.name}".upper())
            if text:
                kind = type(f.default)
                found[f.name] = text.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)
        return cls(**found)
