"""States, modes, mask codes and parameters of the frame-timeline model.

Frame facts are rows (video_id, frame_idx, state, diff). Segments have inclusive ends; cut ranges are half-open.
"""

from __future__ import annotations

from dataclasses import dataclass

NORMAL, PAUSE, SPEED_1X, SPEED_2X, SPEED_02X = 0, 1, 2, 3, 4
SPEEDS = (SPEED_1X, SPEED_2X, SPEED_02X)
CLASSES = ("pause", "speed_1x", "speed_2x", "speed_0_2x")

MODE_AUTO, MODE_KEEP, MODE_ALL = "auto", "keep", "all"
#: Mask codes of a frame in a pause.
AUTO_KEEP, AUTO_DELETE, MANUAL_DELETE, MANUAL_KEEP = 0, 1, 2, 3

VIDEO, FRAME = "video_id", "frame_idx"
DEFAULT_FPS = 30.0


@dataclass(frozen=True)
class Params:
    """Analysis and export parameters with their defaults."""

    batch_size: int = 128
    proc_w: int = 400
    proc_h: int = 225
    threshold_pause: float = 0.7
    threshold_speed_1x: float = 0.7
    threshold_speed_2x: float = 0.7
    threshold_speed_0_2x: float = 0.7
    still_time: float = 0.1
    motion_thresh: float = 2.0
    boundary_thresh: float = 5.0
    speedup_1x: bool = True
    speedup_02: bool = True
    speedup_02_factor: int = 10
    mask_level: int = 10
