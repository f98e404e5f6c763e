"""Settings of the analysis; immutable, built from defaults and nested overrides (dicts or a YAML file)."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Filtering:
    label_confidence_min: float = 0.6
    top_clusters_per_letter: int = 5
    min_doc_coverage: float = 0.33
    excluded_chars: tuple[str, ...] = (",", ".", ";", ":")


@dataclass(frozen=True)
class Styles:
    italic_max: float = 0.1
    italic_min: float = 0.4


@dataclass(frozen=True)
class Alphas:
    base_factors: tuple[float, ...] = (0.1, 0.15)
    exponent_range: tuple[int, int] = (-5, 3)


@dataclass(frozen=True)
class Config:
    filtering: Filtering = field(default_factory=Filtering)
    styles: Styles = field(default_factory=Styles)
    alphas: Alphas = field(default_factory=Alphas)
    epsilon: float = 0.01
    transform: str = "euclidean"
    distance: str = "cosine"
    metric: str = "average"
    ordering: str = "hierarchical"
    reference_corpus: str | None = None
    short_name: str = "last_word"
    short_names: dict[str, str] = field(default_factory=dict)

    CHOICES = {
        "transform": ("translation", "euclidean", "homothety", "similarity", "affinity"),
        "distance": ("cosine", "euclidean", "correlation"),
        "metric": ("average", "roman", "italic"),
        "ordering": ("hierarchical", "index"),
        "short_name": ("last_word", "full"),
    }

    def __post_init__(self) -> None:
        for name, allowed in self.CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")



def merged(base: Any, overrides: dict[str, Any]) -> Any:
    """A copy of the settings with the overrides put in at any depth; unknown names are an error."""
    known = {f.name for f in fields(base)}
    if unknown := set(overrides) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    changes = {}
    for name, value in overrides.items():
        old = getattr(base, name)
        if is_dataclass(old):
            changes[name] = merged(old, value or {})
        elif isinstance(old, tuple) and value is not None:
            changes[name] = tuple(value)
        else:
            changes[name] = value
    return replace(base, **changes)


def load(path: str | Path | None = None, **overrides: Any) -> Config:
    """Defaults, then the YAML file, then the keyword overrides."""
    config = Config()
    if path is not None:
        import yaml

        config = merged(config, yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})
    return merged(config, overrides)


def resolved(paths: dict[str, str], root: str | Path) -> dict[str, str]:
    """Relative paths that don't exist as they are but do below the root, put below the root; others unchanged."""
    out = {}
    for name, value in paths.items():
        below = Path(root) / value if value else Path()
        use_root = value and not Path(value).is_absolute() and not Path(value).exists() and below.exists()
        out[name] = str(below) if use_root else value
    return out
