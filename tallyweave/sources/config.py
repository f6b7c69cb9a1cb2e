"""Project settings in TOML; paths are relative to the file. Code is never executed."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

VARIABLE, NAME = "TALLYWEAVE_CONFIG", "tallyweave.toml"
TEMPLATE = """# one block for each survey
[surveys.example]
workbook = "forms/example.xlsx"
data = "data/example.parquet"
preload = ["preload"]
"""


@dataclass(frozen=True)
class Survey:
    name: str
    workbook: str | None = None
    data: str | None = None
    preload: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    path: str
    surveys: dict[str, Survey] = field(default_factory=dict)
    codes: dict[int, tuple[str, str]] | None = None


def find(start: str = ".") -> Path:
    """The file that the environment names, else the nearest one upwards."""
    if named := os.environ.get(VARIABLE):
        return Path(named)
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / NAME).exists():
            return folder / NAME
    raise FileNotFoundError(f"no {NAME} in {here} or above")


def load(path: str | Path) -> Config:
    p = Path(path)
    raw = tomllib.loads(p.read_text(encoding="utf-8"))
    at = lambda x: str((p.parent / x).resolve()) if x else None
    surveys = {k: Survey(k, at(v.get("workbook")), at(v.get("data")), tuple(at(x) for x in v.get("preload", ()))) for k, v in raw.get("surveys", {}).items()}
    codes = raw.get("codes")
    return Config(str(p), surveys, None if codes is None else {int(k): (v[0], v[1]) for k, v in codes.items()})


def start(folder: str) -> Path:
    """Write a template, unless there is a file already."""
    p = Path(folder) / NAME
    if p.exists():
        raise FileExistsError(p)
    p.write_text(TEMPLATE, encoding="utf-8")
    return p
