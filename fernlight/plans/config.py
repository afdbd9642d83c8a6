"""Settings: defaults, then a TOML file, then the environment, then arguments; every leaf knows where it came from."""

from __future__ import annotations

import copy
import math
import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

ENV_PREFIX = "FERNLIGHT_"
HOME = ".fernlight"
CONFIG_FILE = "fernlight.toml"
# The defaults of every setting.
DEFAULTS: dict[str, Any] = {
    "repo": {"root": ".", "flavor": "auto"},
    "discovery": {
        "include": ["**/*.md"],
        "exclude": ["_eval/**", "skills/**", "templates/**", ".obsidian/**", ".hermes/**", "tmp/**", "_plans/**", ".git/**", f"{HOME}/**", "node_modules/**"],
        "respect_gitignore": True, "follow_symlinks": False, "max_file_bytes": 20_000_000, "exclude_frontmatter_flags": ["excluded_from_wiki_knowledge_base"],
    },
    "storage": {"backend": "parquet", "data_dir": f"{HOME}/db", "url": ""},
    "embedding": {
        "provider": "none", "base_url": "https://api.openai.com/v1/embeddings", "model": "text-embedding-3-small", "dimensions": 1536, "batch_size": 64,
        "max_batch_tokens": 30_000, "max_input_tokens": 8_000, "request_dimensions": False, "timeout_ms": 120_000,
    },
    "chunking": {"target_tokens": 400, "max_tokens": 800, "overlap_tokens": 60, "cjk_char_per_token": 1.6},
    "search": {
        "mode": "hybrid", "rank_fusion": "rrf", "rrf_k": 60, "vector_candidates": 0, "rrf_weights": {"keyword": 1, "vector": 1},
        "tier_boost": {"queries/": 1.5, "concepts/": 1.3, "comparisons/": 1.1, "_meta/": 0.8, "raw/": 0.5},
    },
}
SECRET = re.compile(r"api_?key|password|token$|secret", re.I)


class ConfigError(ValueError):
    """A setting or the index's state that the user has to change; hint says how."""

    def __init__(self, message: str, hint: str = ""):
        super().__init__(message)
        self.hint = hint


@dataclass
class Config:
    values: dict[str, Any]
    sources: dict[str, str] = field(default_factory=dict)
    path: str | None = None
    root: str = "."

    def __getitem__(self, dotted: str) -> Any:
        return get(self.values, dotted)

    def data_dir(self) -> str:
        d = self["storage.data_dir"]
        return d if "://" in d or os.path.isabs(d) else os.path.join(self.root, d)


def get(tree: dict, dotted: str) -> Any:
    for part in dotted.split("."):
        if not isinstance(tree, dict) or part not in tree:
            return None
        tree = tree[part]
    return tree


def put(tree: dict, dotted: str, value: Any) -> None:
    *above, last = dotted.split(".")
    for part in above:
        tree = tree.setdefault(part, {})
    tree[last] = value


def _leaves(tree: dict, prefix: str = ""):
    for k, v in tree.items():
        if isinstance(v, dict):
            yield from _leaves(v, f"{prefix}{k}.")
        else:
            yield f"{prefix}{k}", v


def _merge(config: Config, patch: dict, source: str, into: dict | None = None, prefix: str = "") -> None:
    into = config.values if into is None else into
    for k, v in patch.items():
        if isinstance(v, dict) and isinstance(into.get(k, {}), dict):
            _merge(config, v, source, into.setdefault(k, {}), f"{prefix}{k}.")
        else:
            into[k] = v
            config.sources[f"{prefix}{k}"] = source


def _coerce(text: str, like: Any) -> Any:
    if isinstance(like, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, (int, float)):
        try:
            number = float(text)
        except ValueError:
            raise ConfigError(f"{text!r} is no number") from None
        return int(number) if number.is_integer() else number
    return [x.strip() for x in text.split(",") if x.strip()] if isinstance(like, list) else text


def load(cwd: str = ".", path: str | None = None, overrides: dict[str, Any] | None = None, env: dict[str, str] | None = None) -> Config:
    """overrides: values by dotted name; empty ones are ignored."""
    config = Config(copy.deepcopy(DEFAULTS), root=os.path.abspath(cwd))
    config.sources = {k: "default" for k, _ in _leaves(DEFAULTS)}
    file = Path(cwd, path or CONFIG_FILE)
    if file.exists():
        config.path = str(file)
        try:
            _merge(config, tomllib.loads(file.read_text("utf-8")), "toml")
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"{file}: {e}") from None
    elif path:
        raise ConfigError(f"{file} doesn't exist", "Name an existing file or leave the option out.")
    for name, value in (os.environ if env is None else env).items():
        dotted = name.removeprefix(ENV_PREFIX).lower().replace("__", ".")
        old = get(config.values, dotted)
        if name.startswith(ENV_PREFIX) and old is not None and not isinstance(old, dict):
            put(config.values, dotted, _coerce(value, old))
            config.sources[dotted] = f"env:{name}"
    for dotted, value in (overrides or {}).items():
        if value not in (None, "", 0):
            put(config.values, dotted, value)
            config.sources[dotted] = "flag"
    root = config["repo.root"]
    config.root = root if os.path.isabs(root) else os.path.normpath(os.path.join(config.root, root))
    url = config["embedding.base_url"].rstrip("/")
    put(config.values, "embedding.base_url", url if url.endswith("/embeddings") else f"{url}/embeddings")
    validate(config)
    return config


def validate(config: Config) -> None:
    def check(ok: bool, message: str) -> None:
        if not ok:
            raise ConfigError(message)

    check(config["storage.backend"] in ("parquet", "jdbc"), "storage.backend is parquet or jdbc")
    check(config["storage.backend"] != "jdbc" or config["storage.url"], "storage.backend jdbc needs storage.url")
    check(config["embedding.provider"] in ("none", "openai-compatible", "local"), "embedding.provider is none, openai-compatible or local")
    check(config["search.mode"] in ("hybrid", "keyword", "vector"), "search.mode is hybrid, keyword or vector")
    check(config["search.rank_fusion"] in ("rrf", "weighted_rrf"), "search.rank_fusion is rrf or weighted_rrf")
    check(config["chunking.max_tokens"] >= config["chunking.target_tokens"], "chunking.max_tokens is at least chunking.target_tokens")
    remote = config["embedding.provider"] == "openai-compatible"
    check(not remote or config["embedding.base_url"] not in ("", "/embeddings"), "embedding.base_url is required for an openai-compatible provider")
    check(not remote or config["embedding.model"], "embedding.model is required for an openai-compatible provider")
    n = config["search.vector_candidates"]
    check(isinstance(n, int) and n >= 0, "search.vector_candidates is a whole number and isn't negative")
    check(not n or (config["embedding.provider"] != "none" and config["embedding.dimensions"] > 0), "search.vector_candidates needs an embedding.provider and embedding.dimensions")
    k = config["search.rrf_k"]
    check(isinstance(k, (int, float)) and math.isfinite(k) and k > 0, "search.rrf_k is positive")
    weights = [config["search.rrf_weights.keyword"], config["search.rrf_weights.vector"]]
    check(all(isinstance(w, (int, float)) and w >= 0 for w in weights), "search.rrf_weights aren't negative")
    check(config["search.rank_fusion"] == "rrf" or any(weights), "of search.rrf_weights one is positive")
    check(config["embedding.provider"] == "none" or config["embedding.dimensions"] >= 0, "embedding.dimensions isn't negative")


def display(config: Config) -> dict:
    """Values and sources to show, with secrets hidden; the settings themselves stay as they are."""

    def hide(v: Any, key: str = "") -> Any:
        if isinstance(v, dict):
            return {k: hide(x, k) for k, x in v.items()}
        if isinstance(v, list):
            return [hide(x) for x in v]
        if isinstance(v, str) and v and SECRET.search(key):
            return "[redacted]"
        return re.sub(r"(://[^:/@\s]+):[^@\s]+@", r"\1:[redacted]@", v) if isinstance(v, str) else v

    return {"config": hide(config.values), "sources": dict(config.sources), "config_path": config.path, "root": config.root}


def write_initial(cwd: str, path: str | None = None, overrides: dict[str, Any] | None = None) -> str:
    """A TOML file of the defaults with overrides; never over an existing file."""
    tree = copy.deepcopy(DEFAULTS)
    for dotted, value in (overrides or {}).items():
        put(tree, dotted, value)
    lines: list[str] = []

    def text(v: Any) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(map(text, v)) + "]"
        return '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'

    def section(name: str, part: dict) -> None:
        lines.append(f"[{name}]")
        lines.extend(f"{k if re.fullmatch(r'[A-Za-z0-9_-]+', k) else text(k)} = {text(v)}" for k, v in part.items() if not isinstance(v, dict))
        lines.append("")
        for k, v in part.items():
            if isinstance(v, dict):
                section(f"{name}.{k}", v)

    for k, v in tree.items():
        section(k, v)
    file = Path(cwd, path or CONFIG_FILE)
    with file.open("x", encoding="utf-8") as f:
        f.write("\n".join(lines))
    return str(file)
