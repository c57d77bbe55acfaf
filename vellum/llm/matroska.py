"""Media columns: Matroska files in a binary column, and the packet table that parsing them gives.

The writer makes one audio track of 8-bit samples: blocks of up to eight frames with fixed-size lacing, one
cluster to so many blocks, and cues. The parser reads any file of these elements: variable-length ids and
sizes (also unknown sizes), simple blocks and block groups, all four lacings, cues and clusters.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

#: Element ids of the format (fixed values).
EBML, VERSION, READ_VERSION, ID_LENGTH, SIZE_LENGTH, DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING_FLAG, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, RATE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}

FRAME, LACE, BLOCKS = 576, 8, 64
SAMPLE_RATE = 48_000
#: Timestamps count milliseconds: a frame of 576 samples at 48 kHz is 12 of them.
SCALE_NS, FRAME_TICKS = 1_000_000, 12


def number(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def vint(n: int) -> bytes:
    """An element size in as few bytes as hold it; all ones is kept for unknown sizes."""
    w = 1
    while n >= (1 << 7 * w) - 1:
        w += 1
    return (n | 1 << 7 * w).to_bytes(w, "big")


def element(eid: int, data: bytes) -> bytes:
    return number(eid) + vint(len(data)) + data


def block(track: int, offset: int, frames: list[bytes], lacing: int, flags: int = 0x80) -> bytes:
    """Body of a simple block; lacing 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    head = vint(track) + struct.pack(">hB", offset, flags | lacing << 1)
    if lacing == 0:
        (only,) = frames
        return head + only
    sizes = [len(f) for f in frames]
    lace = bytes([len(frames) - 1])
    if lacing == 1:
        lace += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == 3:
        lace += vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            d, w = b - a, 1
            while not -((1 << 7 * w - 1) - 1) <= d <= (1 << 7 * w - 1) - 1:
                w += 1
            lace += (d + (1 << 7 * w - 1) - 1 | 1 << 7 * w).to_bytes(w, "big")
    return head + lace + b"".join(frames)


_HEADER = element(
    EBML,
    b"".join(element(i, number(n)) for i, n in ((VERSION, 1), (READ_VERSION, 1), (ID_LENGTH, 4), (SIZE_LENGTH, 8))) + element(DOCTYPE, b"matroska") + element(DOCTYPE_VERSION, number(4)) + element(DOCTYPE_READ, number(2)),
)
_AUDIO = element(AUDIO, element(RATE, struct.pack(">d", float(SAMPLE_RATE))) + element(CHANNELS, number(1)) + element(BIT_DEPTH, number(8)))
_TRACK = element(TRACK_ENTRY, element(TRACK_NUMBER, b"\x01") + element(TRACK_UID, b"\x01") + element(TRACK_TYPE, b"\x02") + element(LACING_FLAG, b"\x01") + element(CODEC, b"A_PCM/INT/LIT") + element(DEFAULT_DURATION, number(FRAME_TICKS * SCALE_NS)) + _AUDIO)
_START = element(INFO, element(TIMESTAMP_SCALE, number(SCALE_NS)) + element(MUXER, b"vellum") + element(WRITER, b"vellum")) + element(TRACKS, _TRACK)


def mux(payload: bytes) -> bytes:
    """A file whose frames are the payload, whose length is a multiple of the frame size."""
    body, cues, at, tick = [_START], [], len(_START), 0
    for c in range(0, len(payload), FRAME * LACE * BLOCKS):
        part, base, blocks = payload[c : c + FRAME * LACE * BLOCKS], tick, []
        for s in range(0, len(part), FRAME * LACE):
            frames = [part[i : i + FRAME] for i in range(s, min(s + FRAME * LACE, len(part)), FRAME)]
            blocks.append(element(SIMPLE_BLOCK, block(1, tick - base, frames, 2 if len(frames) > 1 else 0)))
            tick += FRAME_TICKS * len(frames)
        cluster = element(CLUSTER, element(TIMESTAMP, number(base)) + b"".join(blocks))
        cues.append(element(CUE_POINT, element(CUE_TIME, number(base)) + element(CUE_POSITIONS, element(CUE_TRACK, b"\x01") + element(CUE_CLUSTER, number(at)))))
        body.append(cluster)
        at += len(cluster)
    return _HEADER + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def _vint(data: bytes, at: int, keep_mark: bool) -> tuple[int, int]:
    if at >= len(data):
        raise ValueError(f"the file ends at byte {at}, inside an element")
    first = data[at]
    if not first:
        raise ValueError(f"no length mark at byte {at}")
    w = 9 - first.bit_length()
    n = int.from_bytes(data[at : at + w], "big")
    return (n if keep_mark else n ^ 1 << 7 * w), at + w


def _laces(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if lacing == 0:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        each = (end - at) // n
        sizes = [each] * n
    else:
        sizes = []
        while len(sizes) < n - 1:
            if lacing == 1:
                s = 0
                while data[at] == 255:
                    s, at = s + 255, at + 1
                s, at = s + data[at], at + 1
            elif not sizes:
                s, at = _vint(data, at, False)
            else:
                was = at
                d, at = _vint(data, at, False)
                s = sizes[-1] + d - (1 << 7 * (at - was) - 1) + 1
            sizes.append(s)
        sizes.append(end - at - sum(sizes))
    out = []
    for s in sizes:
        out.append((at, at + s))
        at += s
    return out


def parse(data: bytes) -> tuple[list[tuple[int, int, int, int]], dict]:
    """Packets (track, timestamp ns, start, end) and what the file says of itself: scale, duration of a frame, cues, clusters."""
    said = {"scale": 1_000_000, "frame_ns": 0, "cues": [], "clusters": []}
    packets, stamp, segment = [], 0, 0
    todo = [(0, len(data), None)]  # elements are visited in file order: a master's children come before what follows it
    while todo:
        at, end, _ = todo.pop()
        while at < end:
            was = at
            eid, at = _vint(data, at, True)
            mark = at
            size, at = _vint(data, at, False)
            stop = end if size == (1 << 7 * (at - mark)) - 1 else at + size
            if stop > end:
                raise ValueError(f"the element at byte {was} ends at {stop}, its master at {end}")
            if eid in MASTERS:
                if eid == SEGMENT:
                    segment = at
                elif eid == CLUSTER:
                    said["clusters"].append(was - segment)
                todo.append((stop, end, None))
                end = stop
                continue
            if eid == TIMESTAMP_SCALE:
                said["scale"] = int.from_bytes(data[at:stop], "big")
            elif eid == DEFAULT_DURATION:
                said["frame_ns"] = int.from_bytes(data[at:stop], "big")
            elif eid == TIMESTAMP:
                stamp = int.from_bytes(data[at:stop], "big")
            elif eid == CUE_CLUSTER:
                said["cues"].append(int.from_bytes(data[at:stop], "big"))
            elif eid in (SIMPLE_BLOCK, BLOCK):
                track, p = _vint(data, at, False)
                offset, flags = struct.unpack_from(">hB", data, p)
                for k, (s, e) in enumerate(_laces(data, p + 3, stop, flags >> 1 & 3)):
                    if not p + 3 <= s <= e <= stop:
                        raise ValueError(f"a frame of the block at byte {was} passes its end")
                    packets.append((track, (stamp + offset) * said["scale"] + k * said["frame_ns"], s, e))
            at = stop
    return packets, said


# --------------------------------------------------------------------------- Spark


def padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // FRAME)) * FRAME, b"\xff")


def media(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media): the whole text as a Matroska file. A null text is empty, one frame of padding.

    Each row is a file of its own, repeated rows and rows without an id too. Other columns are not read and don't come back; an
    empty table gives an empty result. A text and its file are in a task's memory as a whole.
    """

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                texts = b["text"].slice(s, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(s, 256), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packets(files: DataFrame) -> DataFrame:
    """The packet table of a media column: for each file its packets with track, timestamp, byte range and data, and its cues.

    A null file and one that ends or goes astray inside an element have null packets, payload and cues_hold, and say why in
    `error`, which is null otherwise. A file without elements has no packets. Columns of these names are replaced.
    """
    keep = [c for c in files.columns if c not in ("packets", "payload", "cues_hold", "error")]

    def run(batches):
        kind = pa.list_(pa.struct([("track", pa.int32()), ("ns", pa.int64()), ("start", pa.int64()), ("size", pa.int64())]))
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                rows, data, cued, wrong = [], [], [], []
                for m in part["media"].to_pylist():
                    try:
                        found, said = parse(m)
                    except (TypeError, ValueError, IndexError, struct.error, ZeroDivisionError) as e:
                        for column, value in ((rows, None), (data, None), (cued, None), (wrong, "no file" if m is None else f"{type(e).__name__}: {e}")):
                            column.append(value)
                        continue
                    wrong.append(None)
                    rows.append([{"track": t, "ns": ns, "start": a, "size": e - a} for t, ns, a, e in found])
                    data.append(b"".join([m[a:e] for _, _, a, e in found]))
                    cued.append(sorted(said["cues"]) == said["clusters"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind), pa.array(data, pa.binary()), pa.array(cued, pa.bool_()), pa.array(wrong, pa.string())], names=[*part.schema.names, "packets", "payload", "cues_hold", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name in keep)
    return files.select(*[f"`{c}`" for c in keep]).mapInArrow(run, f"{kinds}, packets array<struct<track: int, ns: long, start: long, size: long>>, payload binary, cues_hold boolean, error string")
