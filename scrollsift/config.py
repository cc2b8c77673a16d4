"""Configuration: TOML, environment, profiles, validation."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

PREFIX = "SCROLLSIFT_"
#: Fixed values that a configuration is checked against.
SCHEMA_VERSION = "1.0.0"
MODES = ("offline", "online")
PROVIDERS = ("groq", "openai", "anthropic", "ollama")


@dataclass
class Storage:
    data_dir: str = "~/.scrollsift"
    max_blob_size: str = "10MB"

    def folder(self) -> str:
        return os.path.expanduser(self.data_dir)


@dataclass
class Capture:
    buffer_size: int = 10_000
    batch_size: int = 100
    flush_interval: str = "5s"


@dataclass
class Patterns:
    entities_file: str = "entities.toml"
    tools_file: str = "tools.toml"
    filters_file: str = "filters.toml"


@dataclass
class Embedding:
    model: str = "all-MiniLM-L6-v2"
    mode: str = "offline"
    batch_size: int = 32


@dataclass
class Llm:
    enabled: bool = False
    provider: str = "groq"
    api_key_env: str = ""
    model: str = ""
    temperature: float = 0.7


@dataclass
class Indexing:
    vector_dim: int = 384
    hnsw_ef_construction: int = 200
    hnsw_m: int = 16


@dataclass
class Retrieval:
    search_multiplier: int = 2
    rrf_k: float = 60.0
    semantic_weight: float = 0.7
    keyword_weight: float = 0.3
    enable_reranking: bool = True
    rerank_candidates_limit: int = 100
    min_similarity_threshold: float = 0.0


@dataclass
class Config:
    schema_version: str = SCHEMA_VERSION
    storage: Storage = field(default_factory=Storage)
    capture: Capture = field(default_factory=Capture)
    patterns: Patterns = field(default_factory=Patterns)
    embedding: Embedding = field(default_factory=Embedding)
    llm: Llm = field(default_factory=Llm)
    indexing: Indexing = field(default_factory=Indexing)
    retrieval: Retrieval = field(default_factory=Retrieval)
    profiles: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str, profile: str | None = None, env: dict[str, str] | None = None) -> Config:
        """File, then environment, then profile; an invalid result is an error that names all faults."""
        given = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        out = cls(schema_version=given.get("_meta", {}).get("schema_version", SCHEMA_VERSION), profiles=given.get("profiles", {}))
        for section in _sections(out):
            kind = type(getattr(out, section))
            known = {f.name for f in fields(kind)}
            setattr(out, section, kind(**{k: v for k, v in given.get(section, {}).items() if k in known}))
        out.override(os.environ if env is None else env)
        if profile is not None:
            out.apply(profile)
        if faults := out.faults(os.environ if env is None else env):
            raise ValueError("; ".join(faults))
        return out

    def save(self, path: str) -> None:
        lines = ["[_meta]", f'schema_version = "{self.schema_version}"', ""]
        tables = {s: asdict(getattr(self, s)) for s in _sections(self)} | {f"profiles.{k}": v for k, v in self.profiles.items()}
        for name, values in tables.items():
            lines += [f"[{name}]", *(f"{k} = {_plain(v)}" for k, v in values.items()), ""]
        Path(path).write_text("\n".join(lines), encoding="utf-8")

    def override(self, env: dict[str, str]) -> None:
        targets = {"LLM__ENABLED": ("llm", "enabled"), "LLM__MODEL": ("llm", "model"), "EMBEDDING__MODE": ("embedding", "mode"), "EMBEDDING__MODEL": ("embedding", "model")}
        for key, (section, name) in targets.items():
            value = env.get(PREFIX + key)
            if value is None:
                continue
            if name == "enabled":
                if value not in ("true", "false"):
                    continue
                value = value == "true"
            setattr(getattr(self, section), name, value)

    def apply(self, profile: str) -> None:
        """An unknown profile changes nothing."""
        chosen = self.profiles.get(profile, {})
        targets = {"embedding_mode": ("embedding", "mode"), "embedding_model": ("embedding", "model"), "llm_enabled": ("llm", "enabled")}
        for key, (section, name) in targets.items():
            if key in chosen:
                setattr(getattr(self, section), name, chosen[key])

    def faults(self, env: dict[str, str]) -> list[str]:
        checks = {
            "_meta.schema_version": self.schema_version == SCHEMA_VERSION,
            "storage.max_blob_size": is_size(self.storage.max_blob_size),
            "capture.buffer_size": self.capture.buffer_size > 0,
            "capture.batch_size": self.capture.batch_size > 0,
            "capture.flush_interval": is_duration(self.capture.flush_interval),
            "patterns.entities_file": bool(self.patterns.entities_file),
            "patterns.tools_file": bool(self.patterns.tools_file),
            "patterns.filters_file": bool(self.patterns.filters_file),
            "embedding.mode": self.embedding.mode in MODES,
            "embedding.batch_size": self.embedding.batch_size > 0,
            "embedding.model": bool(self.embedding.model),
            "llm.api_key_env": not self.llm.enabled or bool(env.get(self.llm.api_key_env)),
            "llm.temperature": 0.0 <= self.llm.temperature <= 2.0,
            "llm.provider": self.llm.provider in PROVIDERS,
            "indexing.vector_dim": self.indexing.vector_dim > 0,
            "indexing.hnsw_ef_construction": self.indexing.hnsw_ef_construction > 0,
            "indexing.hnsw_m": self.indexing.hnsw_m > 0,
        }
        return [f"invalid {name}" for name, good in checks.items() if not good]


def _sections(config: Config) -> list[str]:
    return [f.name for f in fields(config) if f.name not in ("schema_version", "profiles")]


def _plain(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return f"'{value}'" if isinstance(value, str) else repr(value)


def is_size(text: str) -> bool:
    return bool(re.search(r"(?i)b$|^\d*$", text))


def is_duration(text: str) -> bool:
    return bool(re.search(r"[smh]$|^\d*$", text))


def flush_seconds(text: str) -> float:
    """'500ms', '5s' or a bare number; anything else is 5 seconds. Milliseconds are kept."""
    found = re.fullmatch(r"(\d+)(ms|s)?", text)
    return 5.0 if found is None else int(found[1]) / (1000 if found[2] == "ms" else 1)
