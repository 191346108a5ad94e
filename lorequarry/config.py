"""Settings of the engine with their defaults, and fixed tables of source categories."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

#: Source categories by directory, in order of precedence (fixed values).
SOURCE_DIRECTORIES = {"chronicles": "chronicle", "wiki": "wiki", "codex": "official_codex", "ephemera": "ephemera"}
#: Authority of a source category when evidence is ranked, and the variant of the source settings (fixed values).
RANK_AUTHORITY = {"official_codex": 1.00, "chronicle": 0.90, "wiki": 0.80, "ephemera": 0.65, "unknown": 0.50}
SOURCE_AUTHORITY = {"official_codex": 1.00, "chronicle": 0.85, "wiki": 0.65, "ephemera": 0.50, "unknown": 0.40}
#: File kinds that are read (fixed values).
SUPPORTED_EXTENSIONS = (".pdf", ".docx", ".md", ".markdown", ".txt")


@dataclass(frozen=True)
class EngineConfig:
    """Typed settings, the defaults fixed values; ``from_env`` reads QUARRY_<NAME> variables."""

    chunk_size: int = 1200
    chunk_overlap: int = 200
    min_chunk: int = 100
    vector_top_k: int = 10
    final_top_k: int = 8
    max_hops: int = 3
    neighbour_limit: int = 20
    expansions: int = 3
    context_items: int = 15
    prompt_neighbours: int = 12
    entity_limit: int = 20
    path_limit: int = 50
    fuzzy_threshold: float = 0.93
    dimensions: int = 64
    authority: dict = field(default_factory=lambda: dict(RANK_AUTHORITY))

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> EngineConfig:
        env = os.environ if env is None else env
        given = {f.name: env.get(f"QUARRY_{f.name.upper()}") for f in fields(cls) if f.name != "authority"}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in given.items() if v is not None})
