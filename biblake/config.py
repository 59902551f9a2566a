"""Settings: packaged defaults under a user's overrides, and their validation."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path
from typing import Any

from .functions import classify
from .operators.distill import Question, check_questions

#: Defaults.
DEFAULTS: dict[str, Any] = {
    "models": {"bib_extract": "GPT-5.4", "distill": "Claude Sonnet 4.6"},
    "bib": {
        "min_title_similarity": 0.90, "bibtex_title_similarity": 0.85,
        "rate_limits_s": {"openalex": 2.0, "crossref": 2.0, "dblp": 1.0, "semanticscholar": 8.0, "arxiv": 3.0, "osti": 2.0},
        "conflict_thresholds": {"title_sim_min": 0.85, "year_diff_max": 1, "venue_sim_min": 0.70},
        "source_priority": ["human", "osti", "openalex", "crossref", "dblp", "bibtex", "arxiv", "pdf", "llm", "semanticscholar", "derived", "unknown"],
    },
    "md": {"version": "mineru-5"}, "figures": {"version": "figures-2"}, "prompt_versions": {"bib_extract": "bib-2"}, "distill": {"max_input_tokens": 100_000, "queries": {}},
}
REQUIRED_SOURCES = ("human", "osti", "openalex", "crossref")


def merged(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``; dictionaries merge, all else replaces."""
    return {k: merged(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in {**base, **over}}


def flat(tree: dict, prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in tree.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) and v else {f"{prefix}{k}": v}
    return out


def load(path: str | None = None) -> dict:
    """Defaults with the overrides of a JSON file, if it is there."""
    return merged(DEFAULTS, json.loads(Path(path).read_text()) if path and os.path.exists(path) else {})


def origins(path: str | None = None) -> dict[str, str]:
    """Where each setting comes from."""
    own = flat(json.loads(Path(path).read_text())) if path and os.path.exists(path) else {}
    return {k: "override" if k in own else "default" for k in flat(load(path))}


def questions(settings: dict) -> list[Question]:
    return [Question(name=n, **{k: q.get(k) for k in ("scope", "prompt", "max_chars", "model", "section")}) for n, q in settings["distill"]["queries"].items() if isinstance(q, dict)]


def validate(settings: dict) -> list[str]:
    """What is wrong with the settings; nothing if all is right."""
    out = [f"no priority for {s}" for s in REQUIRED_SOURCES if s not in settings["bib"]["source_priority"]]
    out += [f"no rate limit for {s}" for s in ("openalex", "crossref", "dblp", "arxiv") if s not in settings["bib"]["rate_limits_s"]]
    for p in classify.THESIS_VENUES + classify.REPORT_VENUES + classify.WORKSHOP_VENUES + classify.CONFERENCE_VENUES:
        try:
            re.compile(p)
        except re.error as e:
            out.append(f"{p!r}: {e}")
    if not settings["models"].get("distill"):
        out.append("no default model")
    return out + check_questions(questions(settings))
