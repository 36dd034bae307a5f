"""Settings of a job: command arguments, then the environment, then defaults."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping, Sequence
from typing import Any, TypeVar, get_type_hints

T = TypeVar("T")


class SettingError(ValueError):
    """An argument that no setting has, or a value of the wrong kind."""


def _flag(value: str) -> bool:
    known = {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}
    if value.lower() not in known:
        raise ValueError(value)
    return known[value.lower()]


def settings(kind: type[T], args: Sequence[str] = (), environ: Mapping[str, str] | None = None, prefix: str = "") -> T:
    """An instance of the dataclass ``kind``. A field ``event_type`` is set by ``--event-type VALUE`` or ``--event-type=VALUE``, else by the
    environment variable ``<PREFIX>EVENT_TYPE``, else by its default. A truth value is set by ``--name`` alone, or ``--no-name``.
    Unknown arguments and values that don't fit the type stop the job."""
    environ = os.environ if environ is None else environ
    types = get_type_hints(kind)
    fields = {f.name: types[f.name] for f in dataclasses.fields(kind)}  # type: ignore[arg-type]
    given: dict[str, Any] = {}

    def take(name: str, value: str, source: str) -> None:
        try:
            given[name] = (_flag if fields[name] is bool else fields[name])(value)
        except ValueError as e:
            raise SettingError(f"{source}: {value!r} is no {fields[name].__name__}") from e

    for name in fields:
        if (prefix + name).upper() in environ:
            take(name, environ[(prefix + name).upper()], (prefix + name).upper())
    left = list(args)
    while left:
        word, has_value, value = left.pop(0).partition("=")
        name = word.removeprefix("--").replace("-", "_")
        negated = name.startswith("no_") and name not in fields and fields.get(name[3:]) is bool
        if not word.startswith("--") or (name not in fields and not negated):
            raise SettingError(f"unknown argument {word}")
        if negated or (fields[name] is bool and not has_value):
            given[name[3:] if negated else name] = not negated
        else:
            if not has_value and not left:
                raise SettingError(f"{word} needs a value")
            take(name, value if has_value else left.pop(0), word)
    return kind(**given)


def bound(made: Any) -> dict[str, Any]:
    """The settings as named parameters of a query."""
    return dataclasses.asdict(made)
