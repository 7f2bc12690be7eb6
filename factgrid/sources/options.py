"""Settings of a run, from the session or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Setting, and the names under which a session and an environment hold it.
NAMES = {
    "model_key": ("spark.factgrid.model.key", "FACTGRID_MODEL_KEY"),
    "search_key": ("spark.factgrid.search.key", "FACTGRID_SEARCH_KEY"),
    "cache_path": ("spark.factgrid.cache.path", "FACTGRID_CACHE_PATH"),
}


@dataclass(frozen=True)
class Options:
    """model_key is needed by services that ask a language model; without search_key the unkeyed search is used; without cache_path nothing is reused."""

    model_key: str | None = None
    search_key: str | None = None
    cache_path: str | None = None

    @classmethod
    def of(cls, spark: SparkSession) -> Options:
        """The session's settings come before the environment's; empty ones are none."""
        return cls(**{field: spark.conf.get(conf, None) or os.environ.get(env) or None for field, (conf, env) in NAMES.items()})

    def needed_model_key(self) -> str:
        if not self.model_key:
            raise ValueError(f"{NAMES['model_key'][0]} is not set")
        return self.model_key
