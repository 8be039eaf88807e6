"""Configuration on the driver: YAML with environment variables, settings, derived experiments."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from loomdex.functions.options import flag_of, int_of, ints_of, path_of, text_of
from loomdex.operators.chunking import CONFIGS, ChunkConfig
from loomdex.operators.code import CodeConfig
from loomdex.operators.search import MODES, Ranking

# Environment variables of the service and their defaults.
SETTINGS = {"PROFILE": "mvp", "CONFIG_DIR": "configs", "SOURCE": "", "MODE": "hybrid-fused", "DEFAULT_LIMIT": "5", "MAX_LIMIT": "20", "MAX_TEXT_CHARS": "3000"}


def load_yaml(path: str | Path) -> dict:
    """A mapping, {} for an empty file; unknown variables stay as they are."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(path)
    data = yaml.safe_load(path.read_text(encoding="utf-8"))
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise ValueError(f"{path} holds no mapping")
    return expand(data)


def expand(value):
    """`value` with environment variables replaced in every text of it; keys stay."""
    of = {str: os.path.expandvars, list: lambda v: [*map(expand, v)], dict: lambda v: dict(zip(v, map(expand, v.values()), strict=True))}
    return of.get(type(value), lambda v: v)(value)


@dataclass(frozen=True)
class Embedding:
    """The `dense` part of embeddings.yaml. `provider`: the name of an embedder in `dense.PROVIDERS`."""

    provider: str = "hashing"
    model: str = "hashing-64"
    batch_size: int = 32
    query_prefix: str = "query: "
    passage_prefix: str = "passage: "
    cache_enabled: bool = True
    threads: int | None = None
    cuda: bool = False
    device_ids: tuple[int, ...] = ()
    model_cache_dir: str | None = None

    @classmethod
    def from_mapping(cls, given: dict | None) -> Embedding:
        g, d = given or {}, cls()
        keep = lambda value, default: default if value is None else value
        return cls(
            text_of(g.get("provider")) or d.provider, text_of(g.get("model")) or d.model, int_of(g.get("batch_size")) or d.batch_size, keep(g.get("query_prefix"), d.query_prefix), keep(g.get("passage_prefix"), d.passage_prefix),
            keep(flag_of(g.get("cache_enabled")), True), int_of(g.get("threads")), keep(flag_of(g.get("cuda")), False), tuple(ints_of(g.get("device_ids")) or ()), path_of(g.get("model_cache_dir")),
        )


@dataclass(frozen=True)
class Limits:
    """The `indexing` part of limits.yaml; None is no limit."""

    max_file_bytes: int | None = None
    max_chunks_per_file: int | None = None
    max_memory_mb: int | None = None  # of a Python worker
    stop_on_error: bool = False


@dataclass(frozen=True)
class Project:
    """A folder of configuration: sources.<profile>.yaml (or sources.yaml), chunking, embeddings, ranking and limits.yaml, each of which may be absent."""

    sources: list[dict] = field(default_factory=list)
    chunking: dict = field(default_factory=dict)
    embedding: Embedding = field(default_factory=Embedding)
    ranking: Ranking = field(default_factory=Ranking)
    mode: str = "hybrid-fused"
    limits: Limits = field(default_factory=Limits)

    @classmethod
    def load(cls, folder: str | Path, profile: str = "mvp") -> Project:
        folder = Path(folder)
        read = lambda name: load_yaml(folder / name) if (folder / name).exists() else {}
        named = [n for n in (f"sources.{profile}.yaml", "sources.yaml") if (folder / n).exists()]
        chunking, dense, ranking, limits = read("chunking.yaml"), read("embeddings.yaml").get("dense"), read("ranking.yaml"), read("limits.yaml").get("indexing") or {}
        configs = {k: ChunkConfig(int(chunking[k].get("max_chars", CONFIGS[k].max_chars)), int(chunking[k].get("overlap_chars", CONFIGS[k].overlap_chars))) for k in ("markdown", "text", "code") if isinstance(chunking.get(k), dict)}
        if "php" in chunking:
            configs["php"] = CodeConfig.from_mapping(chunking["php"])
        hybrid = ranking.get("hybrid") or {}
        mode = text_of((ranking.get("search") or {}).get("default_mode"))
        return cls(
            read(named[0]).get("sources", []) if named else [], configs, Embedding.from_mapping(dense), Ranking(**{k: int(hybrid[k]) for k in ("dense_candidates", "lexical_candidates", "rrf_k") if k in hybrid}), mode if mode in MODES else "hybrid-fused",
            Limits(int_of(limits.get("max_file_bytes")), int_of(limits.get("max_chunks_per_file")), int_of(limits.get("max_memory_mb")), bool(flag_of(limits.get("stop_on_error")))),
        )


def resolve_eval_file(folder: str | Path, profile: str, given: str | None = None) -> Path:
    """The file that is named, else the first of local, shared and example cases."""
    if given:
        return Path(given)
    for suffix in (".local.yaml", ".yaml", ".example.yaml"):
        path = Path(folder) / f"queries.{profile}{suffix}"
        if path.exists():
            return path
    raise FileNotFoundError(f"no cases for {profile} in {folder}")


@dataclass(frozen=True)
class Settings:
    profile: str
    config_dir: str
    source: str | None
    mode: str
    default_limit: int
    max_limit: int
    max_text_chars: int

    @classmethod
    def from_environment(cls, environ: dict[str, str] | None = None, prefix: str = "LOOMDEX_") -> Settings:
        env = os.environ if environ is None else environ
        get = lambda name: env.get(prefix + name) or SETTINGS[name]
        return cls(get("PROFILE"), get("CONFIG_DIR"), get("SOURCE") or None, get("MODE"), int(get("DEFAULT_LIMIT")), int(get("MAX_LIMIT")), int(get("MAX_TEXT_CHARS")))


def overridden(held: dict, given: dict) -> dict:
    """`held` with the values of `given`, mappings within mappings too; where a mapping asks for `cuda` it names no providers."""
    out = held | {k: overridden(held[k], v) if isinstance(v, dict) and isinstance(held.get(k), dict) else v for k, v in given.items()}
    return {k: v for k, v in out.items() if not (k == "providers" and out.get("cuda"))}


# Options of an experiment and where they go in the configuration, by file and keys.
EXPERIMENT = {
    "model": ("embeddings", "dense", "model"), "provider": ("embeddings", "dense", "providers"), "query_prefix": ("embeddings", "dense", "query_prefix"), "document_prefix": ("embeddings", "dense", "passage_prefix"),
    "cache_path": ("embeddings", "dense", "cache_path"), "model_cache_dir": ("embeddings", "dense", "model_cache_dir"), "local_files_only": ("embeddings", "dense", "local_files_only"), "cuda": ("embeddings", "dense", "cuda"),
    "device_id": ("embeddings", "dense", "device_ids"), "parallel": ("embeddings", "dense", "parallel"), "onnx_log_severity": ("embeddings", "dense", "onnx_log_severity"), "preload_cuda_dependencies": ("embeddings", "dense", "preload_cuda_dependencies"),
    "collection": ("store", "collection"),
}


def experiment_overrides(options: dict) -> dict[str, dict]:
    """The overrides that options of EXPERIMENT make; None overrides nothing."""
    out: dict[str, dict] = {}
    for name, (file, *keys) in EXPERIMENT.items():
        if options.get(name) is not None:
            at = out.setdefault(file, {})
            for key in keys[:-1]:
                at = at.setdefault(key, {})
            at[keys[-1]] = options[name]
    return out


def derive_experiment(source: str | Path, target: str | Path, name: str, overrides: dict[str, dict], force: bool = False) -> list[Path]:
    """Copy the YAML files of a folder to `target/name` with overrides by file stem; originals stay. GPU use removes explicit providers."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", name):
        raise ValueError(f"no name for an experiment: {name!r}")
    folder = Path(target) / name
    if folder.exists() and not force:
        raise FileExistsError(folder)
    folder.mkdir(parents=True, exist_ok=True)
    written = []
    for path in sorted(Path(source).glob("*.yaml")):
        data = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
        merged = overridden(data, overrides.get(path.stem, {}))
        out = folder / path.name
        out.write_text(yaml.safe_dump(merged, sort_keys=False, allow_unicode=True), encoding="utf-8")
        written.append(out)
    readme = folder / "README.md"
    readme.write_text(f"# {name}\n\nDerived from {source}.\n", encoding="utf-8")
    return [*written, readme]
