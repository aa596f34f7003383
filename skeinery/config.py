"""Settings: fixed defaults, environment overrides, and Spark conf overrides under ``skeinery.``."""

from __future__ import annotations

import logging
import os
import sys
from dataclasses import dataclass, fields, replace


# Settings that the environment names as they are; all others are read with the prefix SKEINERY_.
PLAIN = (
    "cross_encoder_model",
    "embed_model",
    "llm_model",
    "log_level",
    "max_chunk_chars",
    "max_content_length",
    "max_context_tokens",
    "port",
    "query_variant_suffixes",
    "rerank_candidates",
    "retrieve_cache_size",
    "rrf_k",
    "search_service_timeout",
    "search_service_url",
)


@dataclass(frozen=True)
class Settings:
    index_root: str = "./index"
    index_name: str = "demo"
    embed_model: str = "hashed-64"
    llm_model: str = ""
    emb_cache_max_size: int = 50_000
    rerank_candidates: int = 30
    retrieve_cache_size: int = 256
    cross_encoder_model: str = ""
    cross_encoder_weight: float = 0.85
    query_variant_suffixes: str = "implementation"
    port: int = 8000
    log_level: str = "INFO"
    max_content_length: int = 65_536
    max_context_tokens: int = 4000
    search_service_url: str = "http://localhost:8000"
    search_service_timeout: float = 120.0
    rrf_k: int = 60
    alpha: float = 0.7
    original_weight: float = 1.5
    narrow_k: int = 6
    wide_k: int = 12
    bm25_k: int = 2
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    top_k: int = 8
    ask_top_k: int = 12
    max_chunk_chars: int = 3200
    window_tokens: int = 800
    window_overlap: int = 150
    result_chars: int = 800
    eval_k: int = 5

    @property
    def suffixes(self) -> tuple[str, ...]:
        """The suffixes split at commas, stripped, empty ones dropped."""
        return tuple(s for s in (x.strip() for x in self.query_variant_suffixes.split(",")) if s)


def load(env=None, spark=None, **overrides) -> Settings:
    """Defaults, then the environment (names in any case), then ``skeinery.<name>`` in the session, then arguments."""
    env = {k.lower(): v for k, v in (os.environ if env is None else env).items()}
    got: dict = {}
    for f in fields(Settings):
        kind = type(f.default)
        named = f.name if f.name in PLAIN else f"skeinery_{f.name}"
        if named in env:
            got[f.name] = kind(env[named])
        if spark is not None and (v := spark.conf.get(f"skeinery.{f.name}", None)) is not None:
            got[f.name] = kind(v)
    return replace(Settings(), **(got | overrides))


def setup_logging(level: str | None = None) -> None:
    """Logs go to stderr; client libraries are quiet unless the level is DEBUG."""
    level = (level or load().log_level).upper()
    logging.basicConfig(stream=sys.stderr, level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s", force=True)
    if level != "DEBUG":
        for name in ("py4j", "urllib3", "pyspark"):
            logging.getLogger(name).setLevel(logging.WARNING)
