"""Media columns: baseline JPEG written and read in numpy, down to DC-only luminance thumbnails.

``read_jpeg`` parses the markers of baseline grey or YCbCr JPEG files, Huffman-decodes their scans and
reconstructs the thumbnail of DC terms: one sample for each 8 x 8 block of the luminance. All restart intervals
of all files of a batch are decoded in step, one block of each at a time, so numpy sees long arrays.

``write_jpeg`` stores any bytes losslessly in this form: a sample is the DC term of a flat grey block under a
quantiser of 8, so the DC-only thumbnail is exactly the payload. A row of 64 blocks is one restart interval. Payloads
beyond the format's height are cut into several frames, one file after the other.

Defined results: a null text is an empty one; an empty text is 64 zero bytes; equal texts give equal values; rows
with equal ids are kept apart; an empty table gives an empty one; further columns are ignored. A stream that is no
baseline JPEG gives null dimensions, an empty thumbnail and an error text, never an exception.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from dotloom.llm.common import text_buffers, with_only

UNIT = 64
#: Blocks of 8 lines in one frame: 65,535 lines at most.
FRAME_ROWS = 8191
#: Payload bytes of a batch that are coded or decoded together.
BATCH_BYTES = 1_500_000

# Fixed values of ITU-T T.81, table K.3: code lengths and symbols of luminance DC differences.
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
#: AC table with one symbol, end of block, of one bit.
AC_COUNTS = bytes([1] + [0] * 15)
AC_SYMBOLS = bytes([0])


def huffman_lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length (0: no code) and symbol for each possible next 16 bits."""
    length, symbol = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
    code = k = 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            lo, hi = code << (16 - bits), (code + 1) << (16 - bits)
            if hi > 65536 or k >= len(symbols):
                raise ValueError("bad Huffman table")
            length[lo:hi], symbol[lo:hi] = bits, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


def _codes(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, bits = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
    c = k = 0
    for n_bits, n in enumerate(counts, 1):
        for _ in range(n):
            code[symbols[k]], bits[symbols[k]] = c, n_bits
            c, k = c + 1, k + 1
        c <<= 1
    return code, bits


_DC_CODE, _DC_BITS = _codes(DC_COUNTS, DC_SYMBOLS)
_SIZE = np.array([int(abs(d)).bit_length() for d in range(-255, 256)], np.uint64)
_D = np.arange(-255, 256)
_EXTRA = np.where(_D >= 0, _D, _D + (1 << _SIZE.astype(np.int64)) - 1).astype(np.uint64)
#: For each difference + 255: the DC code, its further bits and the end-of-block bit as one number, and its bits.
_BLOCK_BITS = (_DC_BITS[_SIZE] + _SIZE + np.uint64(1)).astype(np.int64)
_BLOCK_CODE = ((((_DC_CODE[_SIZE] << _SIZE) | _EXTRA) << np.uint64(1))).astype(np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + bytes([8]) * 64)
        + _segment(0xC0, b"\x08" + (rows * 8).to_bytes(2, "big") + (UNIT * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00")
        + _segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS + b"\x10" + AC_COUNTS + AC_SYMBOLS)
        + _segment(0xDD, UNIT.to_bytes(2, "big"))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def _coded_rows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of rows of 64 samples, 0xFF stuffed, and each row's end among them."""
    level = samples.astype(np.int16) - 128
    diff = level.copy()
    diff[:, 1:] -= level[:, :-1]
    diff = diff.astype(np.int64) + 255
    bits, code = _BLOCK_BITS[diff], _BLOCK_CODE[diff]
    end = np.cumsum(bits, axis=1)
    row_bytes = (end[:, -1] + 7) // 8
    row_at = np.concatenate([[0], np.cumsum(row_bytes)])
    at = (row_at[:-1, None] * 8 + end - bits).ravel()
    # A code of at most 24 bits, shifted within 32, touches four bytes.
    word = code.ravel() << (32 - bits.ravel() - (at & 7))
    byte = at >> 3
    out = np.zeros(row_at[-1] + 4, np.int64)
    for k in range(4):
        part = (word >> (24 - 8 * k)) & 255
        out += np.bincount(byte + k, weights=part, minlength=len(out)).astype(np.int64)[: len(out)]
    out = out[:-4].astype(np.uint8)
    pad = row_bytes * 8 - end[:, -1]
    out[row_at[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    ff = np.flatnonzero(out == 255)
    ends = row_at[1:] + np.searchsorted(ff, row_at[1:])
    if len(ff):
        out = np.insert(out, ff + 1, 0)
    return out, ends


def write_jpeg(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as one or more baseline JPEG frames, one after the other."""
    rows = [len(p) // UNIT for p in payloads]
    if not rows:
        return []
    coded, ends = _coded_rows(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT))
    data, starts = coded.tobytes(), np.concatenate([[0], ends[:-1]]).tolist()
    ends = ends.tolist()
    restart = [bytes([0xFF, 0xD0 + k]) for k in range(8)]
    out, r = [], 0
    for n in rows:
        parts = []
        for frame in range(0, n, FRAME_ROWS):
            m = min(FRAME_ROWS, n - frame)
            parts.append(_head(m))
            for k in range(m):
                if k:
                    parts.append(restart[(k - 1) & 7])
                parts.append(data[starts[r] : ends[r]])
                r += 1
            parts.append(b"\xff\xd9")
        out.append(b"".join(parts))
    return out


class Frame:
    """What the markers of one frame say, and where its entropy-coded bytes lie."""

    def __init__(self):
        self.quant: dict[int, int] = {}
        self.tables: dict[tuple[int, int], tuple[bytes, bytes]] = {}
        self.restart = self.width = self.height = 0
        self.parts: list[tuple[int, int, int, int]] = []  # id, horizontal, vertical, quantiser
        self.scan: list[tuple[int, int, int]] = []  # index of the part, DC table, AC table
        self.begin = self.end = 0


def parse_frames(data: bytes) -> list[Frame]:
    """The frames of one or several JPEG files in a row. Raises ValueError for what isn't baseline."""
    out, at, n = [], 0, len(data)
    while at < n:
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        f, at = Frame(), at + 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 2 > n or data[at] != 0xFF:
                raise ValueError("no marker")
            kind, at = data[at + 1], at + 2
            if kind == 0xD9:
                break
            size = int.from_bytes(data[at : at + 2], "big")
            if size < 2 or at + size > n:
                raise ValueError("bad segment length")
            body, at = data[at + 2 : at + size], at + size
            if kind == 0xDB:
                while body:
                    wide, q = body[0] >> 4, body[0] & 15
                    f.quant[q] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC4:
                while body:
                    m = sum(body[1:17])
                    f.tables[body[0] >> 4, body[0] & 15] = (body[1:17], body[17 : 17 + m])
                    body = body[17 + m :]
            elif kind == 0xDD:
                f.restart = int.from_bytes(body[:2], "big")
            elif kind == 0xC0:
                if body[0] != 8:
                    raise ValueError("not 8 bits a sample")
                f.height, f.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                f.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            elif 0xC1 <= kind <= 0xCF and kind != 0xCC:
                raise ValueError("not baseline")
            elif kind == 0xDA:
                ids = [p[0] for p in f.parts]
                f.scan = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                if not f.parts or len(f.scan) != len(f.parts) or not f.width or not f.height:
                    raise ValueError("a scan of all parts is needed")
                f.begin = at
                while True:  # the scan ends at a marker that is neither stuffing nor a restart
                    at = data.find(b"\xff", at)
                    if at < 0 or at + 1 >= n:
                        raise ValueError("scan without end")
                    nxt = data[at + 1]
                    if nxt == 0 or 0xD0 <= nxt <= 0xD7:
                        at += 2
                    elif nxt == 255:
                        at += 1
                    else:
                        break
                f.end = at
        if not f.scan:
            raise ValueError("no scan")
        out.append(f)
    if not out:
        raise ValueError("empty")
    return out


def _mcu(f: Frame) -> tuple[list[int], int, int, int, int]:
    """Part of each block of an MCU, MCUs across and down, and the first part's sampling factors."""
    if len(f.parts) == 1:  # a scan of one part has no interleaving
        return [0], -(-f.width // 8), -(-f.height // 8), 1, 1
    hm, vm = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
    order = [k for k, _, _ in f.scan for _ in range(f.parts[k][1] * f.parts[k][2])]
    return order, -(-f.width // (8 * hm)), -(-f.height // (8 * vm)), f.parts[0][1], f.parts[0][2]


def _luminance(files: list[bytes], frames: list[tuple[int, Frame]]) -> list[np.ndarray | None]:
    """DC-only luminance of frames that share tables and MCU layout; None for a damaged one."""
    f0 = frames[0][1]
    order, *_ = _mcu(f0)
    tables = {k: huffman_lookup(*f0.tables[k]) for k in {(0, d) for _, d, _ in f0.scan} | {(1, a) for _, _, a in f0.scan}}
    by_part = {k: (tables[0, d], tables[1, a]) for k, d, a in f0.scan}
    # All scans behind each other without stuffing; a segment is what lies between restart markers.
    seg_at, seg_end, seg_mcus, seg_frame, seg_first, pieces, base = [], [], [], [], [], [], 0
    for k, (i, f) in enumerate(frames):
        raw = np.frombuffer(files[i], np.uint8)[f.begin : f.end]
        ff = np.flatnonzero(raw[:-1] == 255) if len(raw) else np.zeros(0, np.int64)
        nxt = raw[ff + 1]
        rst = ff[(nxt >= 0xD0) & (nxt <= 0xD7)]
        keep = np.ones(len(raw), bool)
        keep[ff[nxt == 0] + 1] = False
        keep[rst] = keep[rst + 1] = False
        index = np.concatenate([[0], np.cumsum(keep)])
        starts, ends = np.concatenate([[0], rst + 2]), np.concatenate([rst, [len(raw)]])
        _, across, down, _, _ = _mcu(f)
        every = f.restart or across * down
        firsts = np.arange(len(starts)) * every
        mcus = np.clip(across * down - firsts, 0, every)
        pieces.append(raw[keep])
        seg_at.append(base + index[starts])
        seg_end.append(base + index[ends])
        seg_mcus.append(mcus)
        seg_first.append(firsts)
        seg_frame.append(np.full(len(starts), k))
        base += len(pieces[-1])
    data = np.concatenate([*pieces, np.zeros(16, np.uint8)])
    at, end, mcus, first, owner = (np.concatenate(x) for x in (seg_at, seg_end, seg_mcus, seg_first, seg_frame))
    # The 40 bits from each byte on, as one number: any 32 bits are a shift away.
    wide = np.zeros(len(data) - 8, np.int64)
    for k in range(5):
        wide |= data[k : len(data) - 8 + k].astype(np.int64) << (32 - 8 * k)
    pos, stop = at * 8, end * 8
    luma = [k for k, p in enumerate(order) if p == 0]
    n_seg, most = len(pos), int(mcus.max(initial=0))
    dc_out = np.zeros((most * len(luma), n_seg), np.int16)
    pred = {p: np.zeros(n_seg, np.int32) for p in set(order)}
    bad = np.zeros(n_seg, bool)
    last_byte = len(wide) - 1

    def bits32(where: np.ndarray) -> np.ndarray:
        return (wide[np.minimum(where >> 3, last_byte)] >> (8 - (where & 7))) & 0xFFFFFFFF

    slot = 0
    same = bool((mcus == most).all())
    for m in range(most):
        live = slice(None) if same else np.flatnonzero(mcus > m)
        for p in order:
            (dc_len, dc_sym), (ac_len, ac_sym) = by_part[p]
            here = pos[live]
            v = bits32(here)
            top = v >> 16
            used, size = dc_len[top].astype(np.int64), dc_sym[top].astype(np.int64)
            broken = used == 0
            extra = ((v << used) & 0xFFFFFFFF) >> (32 - size)
            diff = extra - np.where((extra << 1 >> size) == 0, (1 << size) - 1, 0)
            diff[size == 0] = 0
            here = here + used + size
            pred[p][live] += diff.astype(np.int32)
            # AC terms are read past: most blocks here end at once, the rest go on together.
            k_ac = np.ones(len(here), np.int64)
            going = None
            while True:
                idx = slice(None) if going is None else going
                v = bits32(here[idx])
                top = v >> 16
                used, sym = ac_len[top].astype(np.int64), ac_sym[top].astype(np.int64)
                size, run = sym & 15, sym >> 4
                broken[idx] |= used == 0
                here[idx] = here[idx] + used + size
                step = np.where(size > 0, run + 1, np.where(run == 15, 16, 64))
                k_ac[idx] = k_ac[idx] + step
                more = (used > 0) & (k_ac[idx] < 64)
                if not more.any():
                    break
                going = np.flatnonzero(more) if going is None else going[more]
            pos[live] = here
            bad[live] |= broken | (here > stop[live])
            if p == 0:
                dc_out[slot][live] = pred[0][live]
                slot += 1
    out: list[np.ndarray | None] = []
    bounds = np.searchsorted(owner, np.arange(len(frames) + 1))
    for k, (_, f) in enumerate(frames):
        lo, hi = bounds[k], bounds[k + 1]
        order_f, across, down, h, v = _mcu(f)
        if bad[lo:hi].any() or mcus[lo:hi].sum() < across * down:
            out.append(None)
            continue
        per = len(luma)
        blocks = dc_out[:, lo:hi].T  # segment, then its blocks in order
        if (mcus[lo:hi] == most).all():
            blocks = blocks.reshape(-1, per)
        else:
            blocks = np.concatenate([b[: c * per] for b, c in zip(blocks, mcus[lo:hi], strict=True)]).reshape(-1, per)
        grid = blocks[: across * down].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        q = f.quant.get(f.parts[0][3], 1)
        value = np.clip(np.floor_divide(grid.astype(np.int32) * q + 4, 8) + 128, 0, 255).astype(np.uint8)
        hm, vm = (1, 1) if len(f.parts) == 1 else (max(p[1] for p in f.parts), max(p[2] for p in f.parts))
        out.append(value[: -(-f.height * v // (8 * vm)), : -(-f.width * h // (8 * hm))])
    return out


def read_jpeg(files: list[bytes]) -> list[tuple[int, int, np.ndarray] | str]:
    """For each stream: width, height (frames stacked) and DC-only luminance thumbnail; or why it can't be read."""
    out: list = [None] * len(files)
    groups: dict[tuple, list[tuple[int, Frame]]] = {}
    placed: dict[int, list[tuple[tuple, int]]] = {}
    frames_of: dict[int, list[Frame]] = {}
    for i, data in enumerate(files):
        try:
            frames_of[i] = parse_frames(data or b"")
            for f in frames_of[i]:
                key = (tuple(f.scan), tuple(p[1:3] for p in f.parts), tuple(sorted(f.tables.items())))
                g = groups.setdefault(key, [])
                placed.setdefault(i, []).append((key, len(g)))
                g.append((i, f))
        except (ValueError, IndexError, KeyError) as e:
            out[i] = str(e) or type(e).__name__
            placed.pop(i, None)
    done = {}
    for key, g in groups.items():
        try:
            done[key] = _luminance(files, g)
        except (ValueError, KeyError, IndexError) as e:
            done[key] = [None] * len(g)
            for i, _ in g:
                out[i] = out[i] or str(e)
    for i, where in placed.items():
        parts = [done[key][k] for key, k in where]
        if out[i] is None:
            if any(p is None for p in parts) or len({p.shape[1] for p in parts}) > 1:
                out[i] = "damaged scan"
            else:
                out[i] = (frames_of[i][0].width, sum(f.height for f in frames_of[i]), parts[0] if len(parts) == 1 else np.concatenate(parts))
    return out


def thumbnail_hash(thumb: np.ndarray, side: int = 8) -> str:
    """Difference hash of side x side bits, in hex: is each cell's mean of the thumbnail less than its right neighbour's?"""
    h, w = thumb.shape
    rows, cols = np.arange(side + 1) * h // side, np.arange(side + 2) * w // (side + 1)
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    r0, r1 = np.minimum(rows[:-1], h - 1), np.maximum(rows[1:], np.minimum(rows[:-1], h - 1) + 1)
    c0, c1 = np.minimum(cols[:-1], w - 1), np.maximum(cols[1:], np.minimum(cols[:-1], w - 1) + 1)
    cells = (total[r1][:, c1] - total[r0][:, c1] - total[r1][:, c0] + total[r0][:, c0]) / ((r1 - r0)[:, None] * (c1 - c0)[None, :])
    return np.packbits((cells[:, :-1] < cells[:, 1:]).ravel()).tobytes().hex()


# ---------------------------------------------------------------- DataFrame operators
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = "doc_id long, n_bytes long, width int, height int, thumbnail binary, thumbnail_hash string, media_bytes long, media_sha256 string, error string"
DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    start, n, total = 0, len(sizes), 0
    for k in range(n):
        if k > start and total + sizes[k] > limit:
            yield start, k
            start, total = k, 0
        total += sizes[k]
    if n > start:
        yield start, n


def text_to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, media): each text's UTF-8 bytes, padded with zeros, as baseline JPEG."""

    def run(batches):
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            sizes = np.diff(off)
            for lo, hi in _slices(sizes, BATCH_BYTES):
                raw = data[off[lo] : off[hi]].tobytes()
                rel = (off[lo : hi + 1] - off[lo]).tolist()
                payloads = []
                for k in range(hi - lo):
                    p = raw[rel[k] : rel[k + 1]]
                    payloads.append(p + bytes(-len(p) % UNIT if p else UNIT))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(sizes[lo:hi], pa.int64()), pa.array(write_jpeg(payloads), pa.binary())], ["doc_id", "n_bytes", "media"])

    return with_only(docs, "doc_id", "text").mapInArrow(run, MEDIA_SCHEMA)


def _decoded(batches):
    """Each slice of a batch of media with what ``read_jpeg`` gives."""
    for batch in batches:
        _, off = text_buffers(batch.column("media"))
        for lo, hi in _slices(np.diff(off), 2 * BATCH_BYTES):
            part = batch.slice(lo, hi - lo)
            files = [x or b"" for x in part.column("media").to_pylist()]
            yield part, files, read_jpeg(files)


def media_features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) to dimensions, thumbnail, its hash, and the stored form's size and digest."""

    def run(batches):
        for part, files, read in _decoded(batches):
            ok = [not isinstance(r, str) for r in read]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("n_bytes"),
                    pa.array([r[0] if k else None for r, k in zip(read, ok, strict=True)], pa.int32()),
                    pa.array([r[1] if k else None for r, k in zip(read, ok, strict=True)], pa.int32()),
                    pa.array([r[2].tobytes() if k else b"" for r, k in zip(read, ok, strict=True)], pa.binary()),
                    pa.array([thumbnail_hash(r[2]) if k else None for r, k in zip(read, ok, strict=True)], pa.string()),
                    pa.array([len(x) for x in files], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in files], pa.string()),
                    pa.array([None if k else r for r, k in zip(read, ok, strict=True)], pa.string()),
                ],
                ["doc_id", "n_bytes", "width", "height", "thumbnail", "thumbnail_hash", "media_bytes", "media_sha256", "error"],
            )

    return with_only(media, "doc_id", "n_bytes", "media").mapInArrow(run, FEATURE_SCHEMA)


def media_digests(media: DataFrame) -> DataFrame:
    """What ``op5_media`` returns: digests of the payload as read back, and the feature, without the thumbnail itself."""

    def run(batches):
        for part, files, read in _decoded(batches):
            rows = []
            for x, r in zip(files, read, strict=True):
                if isinstance(r, str):
                    raise ValueError(f"stored media can't be read back: {r}")
                p = r[2].tobytes()
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(x), hashlib.sha256(x).hexdigest(), f"{r[0]}x{r[1]}:{thumbnail_hash(r[2])}"))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], [f.split()[0] for f in DIGEST_SCHEMA.split(", ")])

    return with_only(media, "doc_id", "n_bytes", "media").mapInArrow(run, DIGEST_SCHEMA)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` stored as baseline JPEG, read back, with digests and thumbnail hash."""
    return media_digests(text_to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
