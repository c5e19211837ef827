"""Settings of a run from text: a dotenv file or an environment, with typed values, a list of what is wrong, and secrets masked."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import asdict, fields, replace

from quern.operators import answer, fusion
from quern.plans.rag import RagConfig


def parse_dotenv(text: str) -> dict[str, str]:
    """KEY=value lines; comments, blank lines and lines without a key are passed over, export and quotes are dropped."""
    out = {}
    for line in text.splitlines():
        key, equals, value = line.strip().removeprefix("export ").partition("=")
        key, value = key.strip(), value.strip()
        if not equals or not key or key.startswith("#"):
            continue
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        else:
            value = re.split(r"\s+#", value, maxsplit=1)[0]
        out[key] = value
    return out


def _typed(value: str, like):
    if isinstance(like, bool):
        known = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}
        return known[value.strip().lower()]
    return type(like)(value.strip())


def read_config(values: Mapping[str, str], prefix: str = "RAG_") -> RagConfig:
    """A run's settings; a value that does not parse leaves the usual one."""
    c, changed = RagConfig(), {}
    for f in fields(RagConfig):
        like = getattr(c, f.name)
        raw = values.get(prefix + f.name.upper())
        if raw is None or isinstance(like, dict):
            continue
        try:
            changed[f.name] = _typed(raw, like)
        except (KeyError, ValueError):
            continue
    return replace(c, **changed)


def problems(c: RagConfig) -> list[str]:
    """What is wrong with settings; empty if nothing is."""
    checks = [
        (c.mode in fusion.MODES, f"mode is not one of {', '.join(fusion.MODES)}"), (c.fusion in fusion.FUSIONS, f"fusion is not one of {', '.join(fusion.FUSIONS)}"),
        *((getattr(c, k) > 0, f"{k} must be positive") for k in ("dense_k", "keyword_k", "limit", "top_n", "budget", "most_passages", "most_per_document")),
        *((0 <= getattr(c, k) <= 1, f"{k} must be from 0 to 1") for k in ("gate_score", "support")), (c.gate_hits >= 0, "gate_hits must not be negative"),
    ]
    return [said for fine, said in checks if not fine]


def describe(c: RagConfig) -> dict:
    """Every setting and fixed threshold of a run."""
    return asdict(c) | {"min_overlap": answer.MIN_OVERLAP, "duplicate": answer.DUPLICATE, "floor_ratio": answer.FLOOR_RATIO, "misattribution_margin": answer.MARGIN, "rrf_k": fusion.RRF_K}


def redacted(values: Mapping[str, str]) -> dict[str, str]:
    """Values with those of secret names masked but for their last four characters."""
    secret = re.compile(r"(?i)key|secret|token|password|credential")
    return {k: (("*" * 8 + v[-4:] if len(v) > 8 else "*" * len(v)) if secret.search(k) else v) for k, v in values.items()}
