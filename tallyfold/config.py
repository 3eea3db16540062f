"""Settings: environment, the user's file, the folder's file, flags; the last that names one wins."""

from __future__ import annotations

import os
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from pathlib import Path

from tallyfold.errors import UsageError


@dataclass(frozen=True)
class Config:
    store: str = "./tallyfold-store"
    schema_out: str = "./tallyfold-schema.md"
    tolerance: str = "0.01"
    m2m_cap: int = 10_000
    large: int = 64 << 20


def env_file(path: Path) -> dict[str, str]:
    """NAME=value lines; blank lines and comments don't count, nor does a file that isn't there."""
    if not path.is_file():
        return {}
    lines = [x.strip() for x in path.read_text(encoding="utf-8").splitlines()]
    pairs = [x.partition("=") for x in lines if x and not x.startswith("#")]
    return {k.strip(): v.strip() for k, eq, v in pairs if eq and k.strip()}


def resolve(flags: dict[str, object], env: dict[str, str] | None = None, home: Path | None = None, here: Path | None = None) -> Config:
    tiers = [dict(os.environ) if env is None else env, env_file((home or Path.home()) / ".tallyfold" / ".env"), env_file((here or Path.cwd()) / ".env")]
    found: dict[str, str] = {}
    for name in Config.__dataclass_fields__:
        for t in tiers:
            if v := t.get(f"TALLYFOLD_{name.upper()}"):
                found[name] = v
        if flags.get(name) is not None:
            found[name] = str(flags[name])
    for name, what in (("m2m_cap", "cap of row pairs"), ("large", "size of a large file")):
        if not found.get(name, "0").isdigit():
            raise UsageError(f"the {what} must be a whole number, not {found[name]!r}")
    try:
        if Decimal(found.get("tolerance", "0")) < 0:
            raise UsageError("the tolerance must not be negative")
    except InvalidOperation:
        raise UsageError(f"the tolerance must be a decimal number, not {found['tolerance']!r}") from None
    return Config(**{k: int(v) if k in ("m2m_cap", "large") else v for k, v in found.items()})
