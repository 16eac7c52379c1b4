"""Parameters of a run, with the defaults of the command line."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # The defaults of the command line.
    resolution: int = 64
    min_frames: int = 5
    max_scene_frames: int = 100
    target_fps: float = 2.0
    scene_threshold: float = 0.05
    step_size: float = 1.0
    image_similarity: float = 0.99
    image_video_similarity: float = 0.93
    video_similarity: float = 0.93
    max_chunk: int = 2 * 1024 * 1024
    path_format: str = "{D.YYYY}/{D.MM}/{D.DD}/{NAME}.{EXT}"
    seed: str = "0"
    #: Distances count only within the lowest byte of a hash, as a faulty bit count gave them.
    low_byte_distance: bool = False
    #: No neighbours at all when every threshold is 1.
    no_exact_neighbours: bool = False
    #: With a folder for duplicates, representatives are not transferred.
    skip_representatives: bool = False
    #: Of captures that resemble each other, none is kept.
    drop_like_captures: bool = True

    def threshold(self, kind: str) -> float:
        return {"II": self.image_similarity, "IV": self.image_video_similarity, "VV": self.video_similarity}[kind]

    @property
    def least_threshold(self) -> float:
        return min(self.image_similarity, self.image_video_similarity, self.video_similarity)

    def max_bits(self, kind: str | None = None) -> int:
        """Bits in which two 64-bit hashes may differ at a threshold."""
        t = self.threshold(kind) if kind else self.least_threshold
        return int(64 * (1 - t) + 1e-9)
