"""The format of a clip and the numeric range of its samples."""

from __future__ import annotations

from dataclasses import dataclass, replace

BITS = (8, 16, 24, 32)


def native_range(bits: int) -> tuple[int, int]:
    """Smallest and largest sample of a bit depth."""
    if bits not in BITS:
        raise ValueError(f"bits must be one of {BITS}, not {bits}")
    return -(1 << (bits - 1)), (1 << (bits - 1)) - 1


@dataclass(frozen=True)
class Format:
    """Channels, sample rate and bits of a clip; carried beside its samples."""

    channels: int
    sample_rate: int
    bits: int

    def __post_init__(self):
        if self.channels < 1 or self.sample_rate < 1:
            raise ValueError("channels and sample rate must be positive")
        native_range(self.bits)

    def with_(self, **changes: int) -> Format:
        return replace(self, **changes)
