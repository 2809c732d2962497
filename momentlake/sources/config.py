"""Configuration (driver side)."""

from __future__ import annotations

import copy
import os
import tomllib

CPU = "CPUExecutionProvider"

DEFAULTS = {
    "index": {"dim": 512, "metric": "dot"},
    "ingest": {"sample_fps": 2.0, "thumb_width": 320, "proxy_width": 960},
    "motion": {"enabled": True, "method": "score", "min_fraction": 0.002, "heartbeat": 30.0},
    "detect": {"conf": 0.35, "iou": 0.5, "min_px": 20, "max_crops": 12},
    "search": {"top_k": 10, "merge_seconds": 3.0, "use_crops": True},
    "verify": {"enabled": False, "weight": 0.5},
}


def merged(base: dict, over: dict) -> dict:
    """``base`` with ``over`` laid on it, table by table; neither is changed."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load_config(path: str | None = None, *, env: str = "MOMENTLAKE_CONFIG", overlays: tuple[dict, ...] = ()) -> dict:
    """The defaults, the TOML file named by ``path`` or the environment, and further overlays, each laid on the former."""
    out, path = DEFAULTS, path or os.environ.get(env)
    if path:
        with open(path, "rb") as f:
            out = merged(out, tomllib.load(f))
    for o in overlays:
        out = merged(out, o)
    return copy.deepcopy(out)


def choose_providers(requested: list[str], available: list[str], strict: bool = False, override: str | None = None) -> tuple[list[str], list[str]]:
    """The requested providers that are available, in order, and those skipped. Strict: never the CPU, and an error if none is left; else the CPU is the fallback."""
    if override:
        requested = [p.strip() for p in override.split(",") if p.strip()]
    usable = [p for p in requested if p in available and not (strict and p == CPU)]
    skipped = [p for p in requested if p not in usable]
    if not usable and strict:
        raise RuntimeError(f"none of {requested} can be used; available: {available}")
    return usable or [CPU], skipped
