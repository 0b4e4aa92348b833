"""Settings by name with typed defaults."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from quillframe.functions.text import LINE_CONFIDENCE


def number(settings: Mapping[str, str], name: str, default, kind: type = float, strict: bool = True):
    """The setting as a number; ``default`` where it is unset, and where it is no number unless ``strict``."""
    value = settings.get(name)
    if value is None:
        return default
    try:
        return kind(value.strip())
    except ValueError:
        if strict:
            raise ValueError(f"{name}: {value!r} is not a valid {kind.__name__}") from None
        return default


# Names of settings, and their defaults where they are unset.
@dataclass(frozen=True)
class RecognizerSettings:
    """Limits of an external recognizer: confidence floor, permits, seconds."""

    endpoint: str = "http://127.0.0.1:8080/ocr"
    request_timeout: int = 30
    queue_timeout_millis: int = 2000
    max_concurrency: int = 1
    min_confidence: float = LINE_CONFIDENCE
    api_key: str | None = None

    @classmethod
    def read(cls, settings: Mapping[str, str]) -> RecognizerSettings:
        """From settings by name; one that is no number, or out of its range, is an error."""
        url = settings.get("PADDLE_OCR_URL", cls.endpoint)
        if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/]", url):
            raise ValueError(f"invalid PADDLE_OCR_URL: {url!r}")
        found = cls(
            url,
            whole(settings, "PADDLE_OCR_TIMEOUT_SECS", cls.request_timeout),
            whole(settings, "PADDLE_OCR_QUEUE_TIMEOUT_MS", cls.queue_timeout_millis),
            whole(settings, "PADDLE_OCR_MAX_CONCURRENCY", cls.max_concurrency),
            number(settings, "PADDLE_OCR_MIN_CONFIDENCE", cls.min_confidence),
            settings.get("PADDLE_OCR_API_KEY"),
        )
        if found.max_concurrency == 0:
            raise ValueError("PADDLE_OCR_MAX_CONCURRENCY must be greater than zero")
        if not 0 <= found.min_confidence <= 1:
            raise ValueError("PADDLE_OCR_MIN_CONFIDENCE must be between 0 and 1")
        return found


def whole(settings: Mapping[str, str], name: str, default: int) -> int:
    """A setting that is a number of 0 or more."""
    value = number(settings, name, default, int)
    if value < 0:
        raise ValueError(f"{name}: {value} is below zero")
    return value


def local_min_confidence(settings: Mapping[str, str], passport: bool = False) -> float:
    """The confidence floor of a local engine; unlike the external one's, a setting that is no number gives the default."""
    return number(settings, "MRZ_OCR_MIN_CONFIDENCE" if passport else "PADDLE_OCR_MIN_CONFIDENCE", LINE_CONFIDENCE, strict=False)


def backend(settings: Mapping[str, str]) -> str:
    """Which backend reads pages: 'local', or 'sidecar' for the external recognizer; another name is an error."""
    name = settings.get("OCR_BACKEND", "local")
    kinds = {"local": "local", "paddle": "sidecar"}
    if name not in kinds:
        raise ValueError(f"unknown OCR_BACKEND: {name!r}")
    return kinds[name]


def dictionary(path: str) -> list[str]:
    """Lines of a recognizer's dictionary, a symbol each."""
    with open(path, encoding="utf-8") as f:
        return f.read().splitlines()
