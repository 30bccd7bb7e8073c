"""Settings: defaults, then environment variables, then Spark configuration."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

_PREFIX = "spark.quirewright."


@dataclass(frozen=True)
class Settings:
    """Immutable; reading it creates no folders. Names are compared without case in the environment."""

    ollama_host: str = "http://localhost:11434"
    ollama_model: str = "qwen2.5:0.5b"
    model_temperature: float = 0.3
    model_context_length: int = 32_768
    papers_dir: str = "data/papers"
    store_path: str = "data/store"
    store_table: str = "papers"
    chunk_size: int = 2_000
    chunk_overlap: int = 200
    embedding_model: str = "nomic-embed-text"
    embedding_dimensions: int = 768
    embedding_batch_size: int = 32

    @classmethod
    def load(cls, spark: SparkSession | None = None, environ: dict[str, str] | None = None, env_file: str | None = ".env") -> "Settings":
        """Defaults, overridden by the .env file, the environment and ``spark.quirewright.<name>``, in this order."""
        found: dict[str, str] = {}
        if env_file and os.path.isfile(env_file):
            with open(env_file, encoding="utf-8") as f:
                for line in f:
                    name, sep, value = line.strip().partition("=")
                    if sep and not name.startswith("#"):
                        found[name.strip().lower()] = value.strip().strip("\"'")
        found |= {k.lower(): v for k, v in (os.environ if environ is None else environ).items()}
        out = cls()
        for f in fields(cls):
            value = found.get(f.name)
            if spark is not None:
                value = spark.conf.get(_PREFIX + f.name, value)
            if value is not None:
                out = replace(out, **{f.name: type(getattr(out, f.name))(value)})
        return out
