"""Presets and request settings."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Preset:
    size: int
    max_colors: int
    mode: str
    subject: bool
    fg_threshold: float
    mask: int
    posterize_levels: int
    dither_strength: float
    edge_threshold: float | None = None
    edge_darken: float | None = None
    confetti_min_ratio: float = 0.0
    flood_fill: bool = False
    background_tolerance: float = 32


#: The presets by pattern mode.
PRESETS = {
    "pattern": Preset(size=80, max_colors=40, mode="smart", subject=False, fg_threshold=0.0, mask=0xF0, posterize_levels=0, dither_strength=0.25),
    "subject": Preset(size=90, max_colors=28, mode="smart", subject=True, fg_threshold=0.2, mask=0xF0, posterize_levels=8, dither_strength=0.35, edge_threshold=80, edge_darken=0.7),
    "logo": Preset(size=57, max_colors=16, mode="fast", subject=False, fg_threshold=0.0, mask=0xF8, posterize_levels=4, dither_strength=0.2),
}


@dataclass(frozen=True)
class Config:
    """What a request sets; None leaves a setting to the preset."""

    width: int
    height: int
    brand: str = "mard"
    pattern_mode: str = "pattern"
    mode: str = "smart"
    detail_enhance: bool = False
    dither: bool = False
    max_colors: int | None = None
    fg_threshold: float | None = None
    mask: int | None = None
    posterize_levels: int | None = None
    edge_threshold: float | None = None
    edge_darken: float | None = None
    dither_strength: float | None = None
    confetti_min_ratio: float | None = None
    flood_fill: bool | None = None
    background_tolerance: float | None = None

    def __post_init__(self):
        if self.pattern_mode not in PRESETS:
            raise ValueError(f"unknown pattern mode: {self.pattern_mode}")
        if self.width < 1 or self.height < 1:
            raise ValueError("a grid has one cell at least")

    def resolved(self) -> Config:
        """Every setting filled from the preset where the request leaves it open."""
        preset = PRESETS[self.pattern_mode]
        own = {f.name for f in fields(preset)}
        return replace(self, **{f.name: getattr(preset, f.name) for f in fields(self) if getattr(self, f.name) is None and f.name in own})


def config_for(pattern_mode: str, brand: str = "mard", **changes) -> Config:
    """The settings that choosing a pattern mode gives."""
    preset = PRESETS[pattern_mode]
    base = Config(preset.size, preset.size, brand, pattern_mode, preset.mode, detail_enhance=pattern_mode == "subject")
    return replace(base.resolved(), **changes)
