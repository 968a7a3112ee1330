"""Typed settings: an override, else the environment, else a settings file, else the default."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

_TRUE, _FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off", ""}


def cast(value: Any, kind: str) -> Any:
    """A value as str, int, float, bool or json; ValueError if it cannot be."""
    if value is None:
        return None
    if kind == "bool":
        if isinstance(value, bool):
            return value
        text = str(value).strip().lower()
        if text in _TRUE:
            return True
        if text in _FALSE:
            return False
        raise ValueError(f"not a bool: {value!r}")
    if kind == "json":
        return json.loads(value) if isinstance(value, str) else value
    return {"str": str, "int": lambda x: int(float(x)) if isinstance(x, str) and "." in x else int(x), "float": float}[kind](value)


@dataclass(frozen=True)
class Setting:
    key: str
    kind: str = "str"
    default: Any = None
    env: str | None = None
    choices: tuple = ()
    about: str = ""
    group: str = "misc"


@dataclass
class Settings:
    """A registry of settings with their current values."""

    file: dict[str, Any] = field(default_factory=dict)
    known: dict[str, Setting] = field(default_factory=dict)
    overrides: dict[str, Any] = field(default_factory=dict)

    def register(self, key: str, **kw: Any) -> None:
        self.known[key] = Setting(key, **kw)

    def _nested(self, key: str) -> Any:
        at: Any = self.file
        for part in key.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        return at

    def get(self, key: str) -> Any:
        s = self.known[key]
        sources: list[Callable[[], Any]] = [lambda: self.overrides.get(key), lambda: os.environ.get(s.env) if s.env else None, lambda: self._nested(key)]
        for source in sources:
            value = source()
            if value is not None:
                return cast(value, s.kind)
        return s.default

    def set(self, key: str, value: Any) -> None:
        s = self.known[key]
        value = cast(value, s.kind)
        if s.choices and value not in s.choices:
            raise ValueError(f"{key} must be one of {s.choices}")
        self.overrides[key] = value

    def unset(self, key: str) -> None:
        self.overrides.pop(key, None)

    def snapshot(self, only_set: bool = False) -> dict[str, Any]:
        return {k: self.get(k) for k in (self.overrides if only_set else self.known)}

    def environment(self) -> dict[str, str]:
        """The settings as environment variables for another process."""
        out = {}
        for k, s in self.known.items():
            value = self.get(k)
            if s.env and value is not None:
                out[s.env] = value if isinstance(value, str) else json.dumps(value)
        return out

    def problems(self) -> list[str]:
        """What is wrong with the current values."""
        out = []
        for k, s in self.known.items():
            try:
                value = self.get(k)
            except (ValueError, KeyError) as e:
                out.append(f"{k}: {e}")
                continue
            if s.choices and value is not None and value not in s.choices:
                out.append(f"{k}: {value!r} is not one of {s.choices}")
        return out

    def markdown(self) -> str:
        rows = ["| setting | type | default | environment | about |", "|---|---|---|---|---|"]
        rows += [f"| {s.key} | {s.kind} | {s.default} | {s.env or ''} | {s.about} |" for s in self.known.values()]
        return "\n".join(rows) + "\n"


def load(path: str | None = None) -> Settings:
    """The engine's settings, with a settings file if it is there."""
    file: dict[str, Any] = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
    out = Settings(file)
    out.register("segment.least", kind="int", default=8, env="LOOM_SEGMENT_LEAST", about="fewest paragraphs of a scene", group="segment")
    out.register("segment.most", kind="int", default=15, env="LOOM_SEGMENT_MOST", about="most paragraphs of a scene", group="segment")
    out.register("segment.mode", default="rule", choices=("rule", "vector"), env="LOOM_SEGMENT_MODE", about="how scenes are cut", group="segment")
    out.register("model.name", default="offline", env="LOOM_MODEL", about="extractor of the model stages", group="model")
    out.register("model.parallel", kind="int", default=4, env="LOOM_MODEL_PARALLEL", about="concurrent model calls", group="model")
    out.register("model.presets", kind="json", default={}, env="LOOM_MODEL_PRESETS", about="named model end points", group="model")
    out.register("run.chapters", kind="int", default=None, env="LOOM_CHAPTERS", about="last chapter to read", group="run")
    out.register("run.force", kind="bool", default=False, env="LOOM_FORCE", about="redo finished modules", group="run")
    out.register("retrieval.limit", kind="int", default=10, env="LOOM_LIMIT", about="hits of a search", group="retrieval")
    return out


def presets(rows: dict[str, dict]) -> dict[str, dict]:
    """Model presets that say what they need: backend, base_url and model."""
    return {k: v for k, v in rows.items() if all(v.get(c) for c in ("backend", "base_url", "model"))}


def role_models(text: str) -> dict[str, str]:
    """'review=a,mine=b' as a dict; broken parts are passed over."""
    pairs = (part.split("=", 1) for part in (text or "").split(",") if "=" in part)
    return {k.strip(): v.strip() for k, v in pairs if k.strip() and v.strip()}


def api_url(base: str) -> str:
    """The chat end point of a base address."""
    base = base.rstrip("/")
    if base.endswith("/chat/completions"):
        return base
    return f"{base}/chat/completions" if base.endswith(("/v1", "/v3", "/v4")) else f"{base}/v1/chat/completions"
