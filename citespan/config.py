"""User settings: a TOML file of three sections, and the order in which a setting is looked for."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

SECTIONS = ("default", "chat", "summarize")
TEMPLATE = "".join(f'[{s}]\n# api_key = ""\n# model = ""\n# base_url = ""\n' + ("# max_input_chars = 8000\n" if s == "summarize" else "") + "\n" for s in SECTIONS)
API_KEY_ENV, MODEL_ENV, BASE_URL_ENV = "CITESPAN_API_KEY", "CITESPAN_MODEL", "CITESPAN_BASE_URL"
DEFAULT_MODEL, DEFAULT_BASE_URL = "local-model", "http://127.0.0.1:11434/v1"


def config_path() -> Path:
    return Path(os.environ.get("CITESPAN_CONFIG") or Path.home() / ".citespan" / "config.toml")


@dataclass
class Section:
    api_key: str | None = None
    model: str | None = None
    base_url: str | None = None
    max_input_chars: int | None = None


@dataclass
class Config:
    default: Section = field(default_factory=Section)
    chat: Section = field(default_factory=Section)
    summarize: Section = field(default_factory=Section)


def read_table(path: Path | None = None) -> dict:
    try:
        return tomllib.loads((path or config_path()).read_text("utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError):
        return {}


def load(path: Path | None = None) -> Config:
    """The settings; a missing or broken file has none."""
    table = read_table(path)

    def section(name: str) -> Section:
        found = table.get(name) if isinstance(table.get(name), dict) else {}
        text = {k: v for k, v in found.items() if k in ("api_key", "model", "base_url") and isinstance(v, str)}
        most = found.get("max_input_chars")
        return Section(**text, max_input_chars=most if isinstance(most, int) and not isinstance(most, bool) else None)

    return Config(*map(section, SECTIONS))


def resolve(config: Config, section: str, key: str, flag: str | None = None, env: str | None = None, fallback: str | None = None) -> str | None:
    """The first that is set of: command-line flag, environment, the section, [default], the constant."""
    places = (flag, os.environ.get(env) if env else None, getattr(getattr(config, section), key), getattr(config.default, key), fallback)
    return next((v for v in places if v is not None), None)


def normal_key(key: str) -> str:
    return key if "." in key else f"default.{key}"


def typed(text: str) -> int | bool | str:
    return int(text) if re.fullmatch(r"[+-]?\d+", text) else text == "true" if text in ("true", "false") else text


def sensitive(key: str) -> bool:
    return key.rpartition(".")[2] == "api_key"


def get(key: str, path: Path | None = None) -> object | None:
    value: object = read_table(path)
    for part in normal_key(key).split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def _toml(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return '"' + "".join({'"': '\\"', "\\": "\\\\", "\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c, c) for c in value) + '"'
    return "[" + ", ".join(map(_toml, value)) + "]" if isinstance(value, list) else str(value)


def _dump(table: dict, prefix: str = "") -> str:
    own = "".join(f"{k} = {_toml(v)}\n" for k, v in table.items() if not isinstance(v, dict))
    head = f"[{prefix}]\n" if prefix and (own or not table) else ""
    return head + own + "".join(("\n" if own or i else "") + _dump(v, f"{prefix}.{k}" if prefix else k) for i, (k, v) in enumerate((k, v) for k, v in table.items() if isinstance(v, dict)))


def set_value(key: str, value: str, path: Path | None = None) -> str:
    """Store a value under a dotted key; what to show for it.  Raises ValueError if a part isn't a table."""
    path, key = path or config_path(), normal_key(key)
    table = read_table(path)
    *sections, last = key.split(".")
    at = table
    for part in sections:
        at = at.setdefault(part, {})
        if not isinstance(at, dict):
            raise ValueError(f"not a table: {part}")
    at[last] = typed(value)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(_dump(table), "utf-8")
    return f"set {key} = {'****' if sensitive(key) else value}"


def init(path: Path | None = None) -> Path:
    """Write the template; raises FileExistsError if there is a file."""
    path = path or config_path()
    if path.exists():
        raise FileExistsError(f"config already exists: {path}")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(TEMPLATE, "utf-8")
    return path


def censored(text: str) -> str:
    """A config's text with the values of api_key lines masked."""
    return re.sub(r"""(?m)^(\s*api_key\s*=\s*)(?!["']{2}\s*$)\S.*$""", r'\1"****"', text)
