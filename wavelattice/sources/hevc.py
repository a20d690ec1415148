"""H.265 records: decoder configuration, sequence parameter sets and the codecs string."""

from __future__ import annotations

from dataclasses import dataclass

from wavelattice.sources.bits import BitReader, without_emulation


@dataclass(frozen=True)
class Profile:
    space: int
    tier: int
    idc: int
    compatibility: int
    constraints: int  # 48 bits
    level: int

    def codecs(self, entry: str = "hvc1") -> str:
        """The name that playlists use: compatibility bits in reverse, constraint bytes up to the last that is set."""
        space = chr(ord("A") + self.space - 1) if self.space else ""
        reverse = int(f"{self.compatibility:032b}"[::-1], 2)
        bytes_ = self.constraints.to_bytes(6, "big").rstrip(b"\0")
        return ".".join([entry, f"{space}{self.idc}", f"{reverse:X}", f"{'H' if self.tier else 'L'}{self.level}", *(f"{b:X}" for b in bytes_)])


@dataclass(frozen=True)
class HevcConfig:
    profile: Profile
    chroma: int
    luma_bits: int
    chroma_bits: int
    length_size: int
    units: tuple[tuple[int, bool, tuple[bytes, ...]], ...]  # type, complete, units
    segmentation: int = 0
    parallelism: int = 0
    frame_rate: int = 0
    constant_rate: int = 0
    layers: int = 1
    nested: bool = True


SPS = 33


def parse_hvcc(record: bytes) -> HevcConfig:
    r = BitReader(record)
    if r.read(8) != 1:
        raise ValueError("not an HEVC configuration record")
    profile = Profile(r.read(2), r.read(1), r.read(5), r.read(32), r.read(48), r.read(8))
    segmentation = r.read(16) & 0xFFF
    parallelism, chroma = r.read(8) & 3, r.read(8) & 3
    luma, chroma_bits, rate = (r.read(8) & 7) + 8, (r.read(8) & 7) + 8, r.read(16)
    constant, layers, nested, size = r.read(2), r.read(3), r.read(1), r.read(2) + 1
    if size == 3:
        raise ValueError("lengths of three bytes are not allowed")
    units = []
    for _ in range(r.read(8)):
        complete, _, kind = r.read(1), r.read(1), r.read(6)
        own = []
        for _ in range(r.read(16)):
            n = r.read(16)
            own.append(r.read(8 * n).to_bytes(n, "big"))
        units.append((kind, bool(complete), tuple(own)))
    if not any(kind == SPS and own for kind, _, own in units):
        raise ValueError("no sequence parameter set")
    return HevcConfig(profile, chroma, luma, chroma_bits, size, tuple(units), segmentation, parallelism, rate, constant, layers, bool(nested))


def build_hvcc(c: HevcConfig) -> bytes:
    p = c.profile
    head = bytes([1, p.space << 6 | p.tier << 5 | p.idc]) + p.compatibility.to_bytes(4, "big") + p.constraints.to_bytes(6, "big") + bytes([p.level])
    head += (0xF000 | c.segmentation).to_bytes(2, "big") + bytes([0xFC | c.parallelism, 0xFC | c.chroma, 0xF8 | c.luma_bits - 8, 0xF8 | c.chroma_bits - 8])
    head += c.frame_rate.to_bytes(2, "big") + bytes([c.constant_rate << 6 | c.layers << 3 | c.nested << 2 | c.length_size - 1, len(c.units)])
    for kind, complete, own in c.units:
        head += bytes([complete << 7 | kind]) + len(own).to_bytes(2, "big") + b"".join(len(u).to_bytes(2, "big") + u for u in own)
    return head


def parse_sps(nal: bytes) -> dict[str, object]:
    """Profile, chroma format, bit depths and cropped size of a sequence parameter set."""
    if len(nal) < 3 or nal[0] >> 1 & 0x3F != SPS:
        raise ValueError("not an H.265 sequence parameter set")
    r = BitReader(without_emulation(nal[2:]))
    r.read(4)
    below = r.read(3)
    r.read(1)
    profile = Profile(r.read(2), r.read(1), r.read(5), r.read(32), r.read(48), r.read(8))
    present = [(r.read(1), r.read(1)) for _ in range(below)]
    if below:
        r.read(2 * (8 - below))
    for has_profile, has_level in present:
        r.read(88 * has_profile + 8 * has_level)
    r.unsigned_golomb()
    chroma = r.unsigned_golomb()
    planes = chroma == 3 and r.read(1)
    width, height = r.unsigned_golomb(), r.unsigned_golomb()
    if r.read(1):
        left, right, top, bottom = (r.unsigned_golomb() for _ in range(4))
        kind = 0 if planes else chroma
        width -= (2 if kind in (1, 2) else 1) * (left + right)
        height -= (2 if kind == 1 else 1) * (top + bottom)
    luma, chroma_bits = 8 + r.unsigned_golomb(), 8 + r.unsigned_golomb()
    if width <= 0 or height <= 0:
        raise ValueError("the picture has no size")
    return {"profile": profile, "chroma": chroma, "luma_bits": luma, "chroma_bits": chroma_bits, "width": width, "height": height}
