"""Settings of the frame and phrase operators."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from ..functions.text import locale_limits


@dataclass(frozen=True)
class FrameProfile:
    """Fixed default values of the frame operators."""

    name: str = "default"
    filter_regions: bool = True
    skip_similar: bool = True
    concurrent: int = 4
    fingerprint: int = 32
    skip_below: float = 0.03
    reuse_below: float = 0.2
    min_text_height: float = 0.02
    parenthesis_area: float = 0.0055
    most_skew: float = 5.0
    top_band: float = 0.15
    bottom_band: float = 0.10
    top_corner_width: float = 0.2
    top_corner_height: float = 0.35
    bottom_corner_width: float = 0.2
    bottom_corner_height: float = 0.15


PROFILES = {p.name: p for p in (FrameProfile(), replace(FrameProfile(), name="unfiltered", filter_regions=False, skip_similar=False))}


def profile(name: str) -> FrameProfile:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; known: {', '.join(sorted(PROFILES))}")
    return PROFILES[name]


def validate(fps: float) -> float:
    if not 1 <= fps <= 120:
        raise ValueError("fps must be from 1 to 120")
    return fps


@dataclass(frozen=True)
class PhraseLimits:
    """When a phrase ends: a pause, a duration, or a number of characters."""

    pause_ms: int = 600
    most_ms: int = 7000
    most_chars: int = 52
    line_chars: int = 36
    separator: str = " "

    @classmethod
    def for_locale(cls, locale: str, **others) -> PhraseLimits:
        """Limits of a language: characters a line and a cue, and what stands between words."""
        line, cue, separator = locale_limits(locale)
        return cls(most_chars=cue, line_chars=line, separator=separator, **others)


def setting(name: str, given: str | None = None, env: dict[str, str] | None = None, variable: str | None = None, default: str | None = None, needed: bool = False) -> str | None:
    """What was given, else a non-empty variable of the environment, else the default; an error if it is needed and absent."""
    found = given if given is not None else ((os.environ if env is None else env).get(variable or "") or default)
    if needed and not found:
        raise ValueError(f"{name} is needed; give it or set {variable}")
    return found
