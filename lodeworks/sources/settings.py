"""Settings: defaults, the first file that there is, then the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Analysis:
    parallel_processing: bool = True
    max_workers: int = 4
    cache_enabled: bool = True
    cache_ttl_hours: int = 24
    confidence_threshold: float = 0.7
    max_issues_per_category: int = 50


@dataclass(frozen=True)
class Files:
    include_patterns: tuple[str, ...] = ("*.py", "*.js", "*.ts", "*.jsx", "*.tsx")
    exclude_patterns: tuple[str, ...] = ("*/node_modules/*", "*/.git/*", "*/__pycache__/*", "*/venv/*", "*/env/*", "*/.env/*", "*/dist/*", "*/build/*")
    max_file_size_mb: int = 10
    encoding: str = "utf-8"


@dataclass(frozen=True)
class Questions:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    max_context_length: int = 8000
    similarity_threshold: float = 0.7


@dataclass(frozen=True)
class Report:
    default_format: str = "text"
    include_explanations: bool = True
    include_suggestions: bool = True
    max_explanation_length: int = 500
    color_output: bool = True


@dataclass(frozen=True)
class Settings:
    analysis: Analysis = field(default_factory=Analysis)
    parser: Files = field(default_factory=Files)
    qa: Questions = field(default_factory=Questions)
    report: Report = field(default_factory=Report)


#: Section and setting of each variable, without the prefix.
VARIABLES = {"PARALLEL_PROCESSING": ("analysis", "parallel_processing"), "MAX_WORKERS": ("analysis", "max_workers"), "OUTPUT_FORMAT": ("report", "default_format")}


def from_dict(data: Mapping[str, Any]) -> Settings:
    """Sections that are there replace defaults setting by setting; a setting that isn't known is an error, a section isn't."""
    made = {}
    for f in fields(Settings):
        if f.name in data:
            own = {k: tuple(v) if isinstance(v, list) else v for k, v in data[f.name].items()}
            made[f.name] = f.default_factory(**own)  # type: ignore[misc]
    return Settings(**made)


def from_file(path: Path) -> Settings:
    """JSON, or YAML where a YAML reader is installed; defaults if there is no such file."""
    if not path.exists():
        return Settings()
    if path.suffix.lower() in (".yaml", ".yml"):
        import yaml

        return from_dict(yaml.safe_load(path.read_text()) or {})
    return from_dict(json.loads(path.read_text()))


def load(paths: list[Path], environment: Mapping[str, str] = os.environ, prefix: str = "LODEWORKS_") -> Settings:
    """The first of the files that there is, then variables of the prefix."""
    made = next((from_file(p) for p in paths if p.exists()), Settings())
    for name, (section, key) in VARIABLES.items():
        value = environment.get(prefix + name)
        if value:
            own = getattr(made, section)
            kind = type(getattr(own, key))
            given = value.lower() == "true" if kind is bool else kind(value)
            made = replace(made, **{section: replace(own, **{key: given})})
    return made
