"""Run parameters: ``key = int`` text files, validated."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

#: Keys that mean another.
ALIASES = {"bit_depth": "target_bit_depth", "num_rows": "ny", "num_cols": "nx"}


@dataclass
class RunParams:
    reduction_level: int = 1
    rc_operation_mode: int = 1
    dark_threshold_epsilon: int = 0
    target_bit_depth: int = 12
    source_bit_depth: int = 16
    nx: int = -1
    ny: int = -1
    num_frames: int = -1
    frame_offset: int = 0
    num_dark_frames: int = 1
    dark_frame_offset: int = 0
    keep_part_files: int = 0
    keep_dark_data: int = 0
    l2_statistics: int = 1
    l4_centroiding: int = 1
    compression_scheme: int = 0
    compression_level: int = 1
    source_file_type: int = 0
    dark_file_type: int = 0
    num_threads: int = 1
    validation_frame_gap: int = -1
    log_level: int = 0

    def __post_init__(self):
        allowed = {"reduction_level": (1, 2, 3, 4), "rc_operation_mode": (0, 1), "l2_statistics": (0, 1, 2, 3), "l4_centroiding": (0, 1, 2, 3), "compression_level": tuple(range(10)), "source_file_type": (0, 1, 2, 3), "dark_file_type": (0, 1, 2, 3)}
        for k, values in allowed.items():
            if getattr(self, k) not in values:
                raise ValueError(f"{k} = {getattr(self, k)} is not one of {values}")
        if not 1 <= self.target_bit_depth <= 16 or not 1 <= self.source_bit_depth <= 64:
            raise ValueError("bit depth out of range")
        if self.dark_threshold_epsilon < 0 or self.frame_offset < 0 or self.num_frames == 0:
            raise ValueError("negative offset or no frames")

    @classmethod
    def parse(cls, text: str, strict: bool = True) -> "RunParams":
        known, out = {f.name for f in fields(cls)}, {}
        for number, line in enumerate(text.splitlines(), 1):
            line = line.split("#")[0].strip()
            if not line:
                continue
            key, eq, value = line.partition("=")
            key = key.strip().lower()
            key = ALIASES.get(key, key)
            if not eq:
                raise ValueError(f"line {number} has no '='")
            if key not in known:
                if strict:
                    raise ValueError(f"line {number}: unknown key {key!r}")
                continue
            out[key] = int(value.strip())
        return cls(**out)

    def text(self) -> str:
        return "".join(f"{k} = {v}\n" for k, v in asdict(self).items())
