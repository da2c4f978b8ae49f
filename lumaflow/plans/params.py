"""Typed node parameters: defaults, JSON form, checks at admission. Ranges only guide a user's controls."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from lumaflow.model import ContractError


@dataclass(frozen=True)
class Param:
    """kind: float, int, bool, choice or path. A choice's options map names to None or to a schema of their own."""

    kind: str
    default: Any = None
    low: float | None = None
    high: float | None = None
    options: dict[str, Schema | None] = field(default_factory=dict)
    external: bool = False

    def admit(self, name: str, value: Any) -> Any:
        fits = {
            "float": isinstance(value, (int, float)) and not isinstance(value, bool),
            "int": isinstance(value, int) and not isinstance(value, bool),
            "bool": isinstance(value, bool),
            "path": value is None or isinstance(value, str),
            "choice": True,
        }[self.kind]
        if not fits:
            raise ContractError(f"parameter {name}: {value!r} is no {self.kind}")
        if self.kind == "choice":
            return self._choice(name, value)
        return float(value) if self.kind == "float" else value

    def _choice(self, name: str, value: Any) -> Any:
        if isinstance(value, str) and value in self.options and self.options[value] is None:
            return value
        if isinstance(value, dict) and len(value) == 1:
            (key, inner), *_ = value.items()
            if self.options.get(key) is not None:
                return {key: self.options[key].admit(inner)}
        raise ContractError(f"parameter {name}: {value!r} is no choice of {sorted(self.options)}")


@dataclass(frozen=True)
class Schema:
    params: dict[str, Param] = field(default_factory=dict)
    check: Callable[[dict], None] | None = None
    strict: bool = True

    def defaults(self) -> dict:
        return {k: p.default for k, p in self.params.items()}

    def admit(self, values: dict | None) -> dict:
        values = values or {}
        if self.strict and (unknown := set(values) - set(self.params)):
            raise ContractError(f"unknown parameters {sorted(unknown)}")
        out = {k: p.admit(k, values.get(k, p.default)) for k, p in self.params.items()}
        if self.check:
            self.check(out)
        return out

    def reset_external(self, values: dict) -> dict:
        """A template's form: external parameters go back to their defaults."""
        return {k: self.params[k].default if self.params[k].external else v for k, v in values.items()}


def finite(*names: str) -> Callable[[dict], None]:
    def check(values: dict) -> None:
        for n in names:
            if not math.isfinite(values[n]):
                raise ContractError(f"parameter {n} must be finite")

    return check
