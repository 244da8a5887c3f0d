"""All thresholds, passed explicitly into plans as literals. Defaults are the deployed values."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import TypeVar

T = TypeVar("T")


@dataclass(frozen=True)
class FateConfig:
    """Second pass over trajectories. Frames are raw unless said otherwise."""

    stable_samples: int = 3
    shrink_ratio: float = 0.92
    min_move_px: float = 40.0
    lost_frames: int = 3
    min_body_ratio: float = 0.10
    successor_gap: int = 50
    successor_px: float = 120.0
    #: Off: rules for inside-to-outside visits and for loss at the exit hold for tracks of any origin.
    require_exit_origin: bool = False


@dataclass(frozen=True)
class CountConfig:
    """Live exit counting."""

    anchor_x: float = 0.5
    anchor_y: float = 0.5
    min_move_px: float = 40.0
    shrink_ratio: float = 0.92
    head_window: int = 5
    lost_frames: int = 3
    door_visible_frames: int = 12
    stable_samples: int = 3
    startup_last_frame: int = 90
    stride: int = 3
    startup_frames: int = 3
    min_body_ratio: float = 0.10
    lock_frames: int = 18
    lock_px: float = 85.0
    lock_reid_frames: int = 60
    lock_similarity: float = 0.82
    #: A track that was never stably inside may exit if it was in the door and seen early.
    allow_preboarded: bool = True
    #: ``offline``: the greater of the live and the second pass's exits; ``streaming``: the live ones.
    mode: str = "offline"


@dataclass(frozen=True)
class TrackConfig:
    """Association of detections with tracks; lost frames are processed frames."""

    min_iou: float = 0.3
    center_px: float = 90.0
    center_size_factor: float = 2.6
    archive_after: int = 45
    reid_similarity: float = 0.65
    refresh_every: int = 4
    blend: float = 0.2
    fallback_lost: int = 15
    fallback_px: float = 250.0
    birth_confidence: float = 0.35
    spawn_confidence: float = 0.25


@dataclass(frozen=True)
class BoxConfig:
    """Head and body boxes."""

    head_height: float = 0.28
    head_width: float = 0.65
    head_min_px: float = 12.0
    body_widths: float = 2.8
    body_heights: float = 5.5
    max_width: float = 0.24
    max_height: float = 0.38
    max_area: float = 0.08
    mask_x: float = 0.30
    mask_y: float = 0.36
    mask_share: float = 0.35
    max_iou: float = 0.5


@dataclass(frozen=True)
class DetectorConfig:
    """Output of a head detector."""

    form: str = "xywh-score-class"
    input_size: int = 640
    threshold: float = 0.25


@dataclass(frozen=True)
class LineConfig:
    """Optional counting by a band around a horizontal line."""

    min_move_px: float = 40.0
    stable_samples: int = 3
    inside_on_top: bool = True
    #: Count as soon as the middle of the band is crossed towards the inside.
    center_crossing: bool = False


@dataclass(frozen=True)
class StopConfig:
    """Smart stop: door signature and early end of a clip."""

    calibration_samples: int = 6
    need_activity: bool = True
    stable_motion: float = 0.30
    open_max: float = 0.10
    closed_min: float = 0.22
    scene_motion: float = 0.14
    vehicle_confirm_s: float = 5.0
    min_seconds: float = 8.0
    max_seconds: float = 0.0
    closed_confirm_s: float = 4.0
    clear_s: float = 2.0
    motion_fallback: bool = True
    inactivity_s: float = 30.0
    post_roll_s: float = 3.0


def configured(kind: type[T], values: Mapping[str, str], prefix: str = "") -> T:
    """Settings of a kind, with the defaults replaced by texts (of the environment or a file) named ``prefix`` and the field, case and _ or - aside.

    A text that isn't of the field's type raises ValueError; empty ones are left out.
    """
    plain = {k.lower().replace("-", "_"): v for k, v in values.items()}
    switches = {"true": True, "1": True, "yes": True, "on": True, "false": False, "0": False, "no": False, "off": False}
    found = {}
    for f in fields(kind):
        text = plain.get(f"{prefix}{f.name}".lower().replace("-", "_"), "").strip()
        if not text:
            continue
        if isinstance(f.default, bool):
            if text.lower() not in switches:
                raise ValueError(f"{f.name} is neither true nor false: {text}")
            found[f.name] = switches[text.lower()]
        else:
            found[f.name] = type(f.default)(text)
    return kind(**found)
