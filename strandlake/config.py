"""Settings from YAML, a .env file, the environment and the command line, later ones over earlier ones."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

import yaml

_NAME = re.compile(r"\$\{(\w+)\}")


def expand(value: Any, env: Mapping[str, str]) -> Any:
    """Replaces ${NAME} in all strings; a name that isn't set is a KeyError."""
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, env) for v in value]
    return _NAME.sub(lambda m: env[m[1]] if m[1] in env else env[m[1].upper()], value) if isinstance(value, str) else value


def read_dotenv(path: str | Path) -> dict[str, str]:
    out = {}
    for line in Path(path).read_text().splitlines() if Path(path).exists() else []:
        key, sep, value = line.strip().partition("=")
        if sep and not key.startswith("#"):
            out[key.removeprefix("export ").strip()] = value.strip().strip("\"'")
    return out


def merged(a: dict, b: Mapping) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
    return out


def from_environment(env: Mapping[str, str], prefix: str) -> dict:
    """PREFIX_A__B=x as {"a": {"b": x}}."""
    out: dict = {}
    for name, value in env.items():
        if name.upper().startswith(prefix.upper() + "_"):
            *heads, tail = name[len(prefix) + 1 :].lower().split("__")
            at = out
            for h in heads:
                at = at.setdefault(h, {})
            at[tail] = yaml.safe_load(value)
    return out


def load(defaults: dict, path: str | None = None, prefix: str = "STRANDLAKE", dotenv: str = ".env", overrides: Mapping | None = None, env: Mapping[str, str] | None = None) -> dict:
    env = dict(os.environ if env is None else env)
    dot = read_dotenv(dotenv)
    out = dict(defaults)
    if path:
        out = merged(out, expand(yaml.safe_load(Path(path).read_text()) or {}, {**dot, **env}))
    out = merged(out, from_environment(dot, prefix))
    out = merged(out, from_environment(env, prefix))
    return merged(out, {k: v for k, v in (overrides or {}).items() if v is not None})
