"""Settings of a run: one file, read once, with the model's name and key from the environment."""

from __future__ import annotations

import functools
import json
import os

#: Used where a file says nothing.
DEFAULTS = {"judge": {"model": "", "max_excerpt_chars": 2000}, "tournament": {"appearances": 30, "sigma_convergence": 0.0}, "corpus": {"split_report_sections": False}}


@functools.cache
def settings(path: str = "") -> dict:
    """DEFAULTS with the sections of a JSON file (or a YAML one, if a parser is installed) over them. JUDGE_MODEL in the environment wins."""
    own = {}
    if path:
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                own = yaml.safe_load(f) or {}
            else:
                own = json.load(f)
    out = {k: {**DEFAULTS.get(k, {}), **own.get(k, {})} if isinstance(own.get(k, {}), dict) else own[k] for k in DEFAULTS | own}
    out["judge"]["model"] = os.environ.get("JUDGE_MODEL", out["judge"]["model"])
    return out


def secret(name: str) -> str:
    """A key from the environment; an error names it if it is missing."""
    if not os.environ.get(name):
        raise KeyError(f"{name} is not set in the environment")
    return os.environ[name]
