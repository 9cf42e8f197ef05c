"""Settings from a TOML file and the environment, checked as a whole."""

from __future__ import annotations

import os
import tomllib
import warnings
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """Settings of jobs; ``VELLICHOR_<NAME>`` in the environment wins over the file."""

    keep_versions: int = 3
    verification_days: int = 365
    log_days: int = 90
    window_days: int = 30
    max_age_seconds: int = 86_400
    rate: float = 1.0
    burst: float = 3.0
    search_cells: int = 0  # 0: searches may take as long as they need

    def checked(self) -> Config:
        if self.keep_versions < 1:
            raise ValueError("keep_versions must be 1 or more")
        for name in ("verification_days", "log_days", "window_days", "max_age_seconds", "search_cells"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} can't be negative")
        if self.rate <= 0 or self.burst < 1:
            raise ValueError("rate must be above 0 and burst 1 or more")
        return self


def load_config(path: str | None = None, environment: dict[str, str] | None = None) -> Config:
    """Defaults, then the file's sections, then the environment; an unknown key warns, a value of the wrong type is an error."""
    known = {f.name: type(f.default) for f in fields(Config)}
    given: dict[str, object] = {}
    if path:
        with open(path, "rb") as file:
            for section, values in tomllib.load(file).items():
                for key, value in (values if isinstance(values, dict) else {section: values}).items():
                    if key in known:
                        given[key] = value
                    else:
                        warnings.warn(f"unknown setting {key!r}", stacklevel=2)
    for key, value in (os.environ if environment is None else environment).items():
        if key.startswith("VELLICHOR_") and (name := key.removeprefix("VELLICHOR_").lower()) in known:
            given[name] = value
    return replace(Config(), **{k: known[k](v) for k, v in given.items()}).checked()
