"""Matroska files as bytes: written for tests and storage, parsed into packets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

# Element ids: fixed values of the format.
EBML, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE = 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE, CUE_POSITIONS}
#: Elements of the top two levels, where one of unknown size ends.
_UPPER = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
NONE, XIPH, FIXED, VARIABLE = 0, 1, 2, 3  # lacings


class Malformed(ValueError):
    """The bytes are no element where one must be."""


def number(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """A variable-length number: value, width, and all value bits set."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Malformed(f"number cut off at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    full = (1 << 7 * width) - 1
    return (raw if keep_marker else raw & full), width, full


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    #: (track, timestamp in ns, key frame, lacing, offset, size)
    packets: list[tuple[int, int, bool, int, int, int]] = field(default_factory=list)
    #: (timestamp in ns, track, byte of the cluster)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """``(id, start, end)`` of the payloads of elements one after another."""
    while at < end:
        key, width, _ = number(data, at, keep_marker=True)
        size, more, unknown = number(data, at + width)
        start = at + width + more
        if size == unknown:
            stop = _end_of_unknown(data, key, start, end)
        else:
            stop = start + size
            if stop > end:
                raise Malformed(f"element {key:#x} at byte {at} ends beyond its parent")
        yield key, start, stop
        at = stop


#: The format nests eight levels at most; what goes deeper is no file of it.
DEEPEST = 32


def _end_of_unknown(data: bytes, key: int, at: int, end: int, depth: int = 0) -> int:
    """Where an element of unknown size ends: before one that it can't hold."""
    if depth > DEEPEST:
        raise Malformed("elements of unknown size are nested too deep")
    while at < end:
        inner, width, _ = number(data, at, keep_marker=True)
        if inner in _UPPER and (key != SEGMENT or inner in (EBML, SEGMENT)):
            return at
        size, more, unknown = number(data, at + width)
        at += width + more
        at = _end_of_unknown(data, inner, at, end, depth + 1) if size == unknown else at + size
    return end


def _laces(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if lacing == NONE:
        return [(at, end - at)]
    frames, at, sizes = data[at] + 1, at + 1, []
    if lacing == FIXED:
        each, rest = divmod(end - at, frames)
        if rest:
            raise Malformed("frames of a fixed lacing differ")
        sizes = [each] * frames
    else:
        for k in range(frames - 1):
            if lacing == XIPH:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                value, width, full = number(data, at)
                size = value if not k else sizes[-1] + value - (full >> 1)
                at += width
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed("laced frames end beyond their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """Read a file's structure; frames are given by their byte ranges."""
    media, segment = Media(), 0

    def integer(start: int, stop: int) -> int:
        return int.from_bytes(data[start:stop], "big")

    def block(start: int, stop: int, base: int, simple: bool) -> None:
        track, width, _ = number(data, start)
        time = int.from_bytes(data[start + width : start + width + 2], "big", signed=True)
        flags = data[start + width + 2]
        lacing = flags >> 1 & 3
        frames = _laces(data, start + width + 3, stop, lacing)
        step = media.tracks.get(track, {}).get(DEFAULT_DURATION, 0)
        for k, (at, size) in enumerate(frames):
            media.packets.append((track, (base + time) * media.scale + k * step, bool(flags & 128) if simple else True, lacing, at, size))

    def walk(start: int, stop: int, into: dict, base: int = 0, depth: int = 0) -> None:
        nonlocal segment
        if depth > DEEPEST:
            raise Malformed("elements are nested too deep")
        for key, a, b in elements(data, start, stop):
            if key == SEGMENT:
                segment = a
                walk(a, b, into, depth=depth + 1)
            elif key == CLUSTER:
                media.clusters.append(a)
                base = next((integer(x, y) for k, x, y in elements(data, a, b) if k == TIMESTAMP), 0)
                walk(a, b, into, base)
            elif key in (SIMPLE_BLOCK, BLOCK):
                block(a, b, base, key == SIMPLE_BLOCK)
            elif key == TRACK:
                own: dict = {}
                walk(a, b, own, depth=depth + 1)
                media.tracks[own.get(TRACK_NUMBER, 0)] = own
            elif key == CUE:
                own = {}
                walk(a, b, own, depth=depth + 1)
                media.cues.append((own.get(CUE_TIME, 0) * media.scale, own.get(CUE_TRACK, 0), segment + own.get(CUE_CLUSTER, 0)))
            elif key == EBML:
                media.doc_type = next((data[x:y].decode(errors="replace") for k, x, y in elements(data, a, b) if k == DOC_TYPE), "")
            elif key in _MASTERS:
                walk(a, b, into, base, depth + 1)
            elif key == TIMESTAMP_SCALE:
                media.scale = integer(a, b)
            elif key in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION, CHANNELS, BIT_DEPTH, CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                into[key] = integer(a, b)

    walk(0, len(data), {})
    if any(abs(x) >= 1 << 63 for row in (*media.packets, *media.cues) for x in row):
        raise Malformed("a number is too large")
    return media


def _size(n: int) -> bytes:
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(key: int, payload: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + _size(len(payload)) + payload


def _uint(key: int, value: int) -> bytes:
    return _element(key, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes]) -> tuple[int, bytes]:
    """The lacing for some frames, and its head: fixed if they are alike."""
    if len(frames) == 1:
        return NONE, b""
    if len({len(f) for f in frames}) == 1:
        return FIXED, bytes([len(frames) - 1])
    head, last = bytes([len(frames) - 1]) + _size(len(frames[0])), len(frames[0])
    for f in frames[1:-1]:
        step, last = len(f) - last, len(f)
        width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1) - 1)
        head += (step + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return VARIABLE, head


RATE, FRAME = 8_000, 192
#: Frames of a block and blocks of a cluster: 24 ms each, so that times fit in 16 bits.
LACED, BLOCKS = 8, 128


def mux(samples: bytes) -> bytes:
    """One track of 8-bit PCM samples, framed, laced, clustered and cued."""
    scale, step = 1_000_000, FRAME * 1_000_000_000 // RATE
    head = _element(EBML, _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 2) + _uint(DOC_TYPE_READ_VERSION, 2))  # simple blocks came with 2
    info = _element(INFO, _uint(TIMESTAMP_SCALE, scale))
    audio = _element(AUDIO, _element(FREQUENCY, b"\x45\xfa\x00\x00") + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    track = _element(TRACK, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, step) + audio)
    parts, cues = [info, _element(TRACKS, track)], []
    at, each = sum(map(len, parts)), LACED * BLOCKS
    for first in range(0, -(-len(samples) // FRAME), each):
        time = first * step // scale
        body = [_uint(TIMESTAMP, time)]
        for k in range(first, min(first + each, -(-len(samples) // FRAME)), LACED):
            frames = [samples[i : i + FRAME] for i in range(k * FRAME, min((k + LACED) * FRAME, len(samples)), FRAME)]
            lacing, lace = _lace(frames)
            body.append(_element(SIMPLE_BLOCK, b"\x81" + (k * step // scale - time).to_bytes(2, "big") + bytes([128 | lacing << 1]) + lace + b"".join(frames)))
        cues.append(_element(CUE, _uint(CUE_TIME, time) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(_element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    return head + _element(SEGMENT, b"".join([*parts, _element(CUES, b"".join(cues))]))
