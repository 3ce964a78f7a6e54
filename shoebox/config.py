"""Semantic constants of the engine, gathered in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    # Fixed values of the catalogue's semantics.
    phash_distance: int = 7
    frame_distance: int = 8
    video_overlap: float = 0.7
    face_eps: float = 0.35
    face_match: float = 0.55
    face_detection: float = 0.5
    cleanup_margin: float = 0.45
    semantic_cutoff: float = 0.18
    softmax_temperature: float = 20.0
    label_probability: float = 0.15
    label_count: int = 3
    scene_jump: int = 10
    sampled_frames: int = 300
    representative_frames: int = 20
    max_download_mb: int = 2048
    quality_floor: float = 0.25
    preview_px: int = 1600
    keeper_time: str = "chronological"  # or "compat": the sum of character codes of the date text
    settings: dict = field(default_factory=dict)


DEFAULT = EngineConfig()
