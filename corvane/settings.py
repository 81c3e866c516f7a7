"""Settings from the environment, read anew at each call."""

from __future__ import annotations

import os
from collections.abc import Mapping
from datetime import UTC, datetime

# Words that switch a flag.
YES, NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


class SettingError(ValueError):
    """A setting with a value that can't be used."""


def text(name: str, default: str = "", env: Mapping[str, str] | None = None) -> str:
    """The value as it is, or the default where it isn't set."""
    return (os.environ if env is None else env).get(name, default)


def flag(name: str, default: bool | None = None, env: Mapping[str, str] | None = None) -> bool | None:
    """True or False by its word, in any case; the default (None for a flag of three states) where it is unset, blank or another word."""
    word = text(name, env=env).strip().lower()
    return True if word in YES else False if word in NO else default


def whole(name: str, default: int | None = None, low: int | None = None, high: int | None = None, env: Mapping[str, str] | None = None) -> int | None:
    """A whole number from low to high, both if given; the default where it is unset or blank. Anything else is an error."""
    given = text(name, env=env).strip()
    if not given:
        return default
    try:
        value = int(given)
    except ValueError as e:
        raise SettingError(f"{name} must be a whole number, not {given!r}") from e
    if (low is not None and value < low) or (high is not None and value > high):
        raise SettingError(f"{name} must lie between {low if low is not None else 'any'} and {high if high is not None else 'any'}, not {value}")
    return value


def first(names: list[str], default: str = "", env: Mapping[str, str] | None = None) -> str:
    """The first of several settings that isn't blank, without blanks at its ends."""
    return next((v for n in names if (v := text(n, env=env).strip())), default)


def utc_now() -> str:
    """P5: the time in UTC, to the second."""
    return datetime.now(UTC).isoformat(timespec="seconds")
