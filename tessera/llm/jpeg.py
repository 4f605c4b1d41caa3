"""Baseline JPEG columns: payloads as flat 8x8 blocks, DC-only luminance thumbnails, thumbnail hashes.

Storing: a payload byte is one 8x8 block of that grey level. With a DC quantiser of 8 the quantised
DC coefficient is the byte less 128 and every AC coefficient is zero, so a standard baseline stream
keeps the payload without loss. Each block row is a restart interval, which makes the rows of all
images of a batch independent lanes.

Reading: markers are parsed, the scan is cut at its restart markers and un-stuffed, and all lanes
of a batch are Huffman-decoded in step with numpy (AC symbols are skipped over, DC is kept). It
reads any baseline stream: several components, sampling factors, own tables, no restart intervals.

Defined cases: a null or empty payload text is one tile of 576 bytes 255. Payloads over
MAX_IMAGE_BYTES become several images one after another. Bytes that aren't a baseline JPEG decode
to a null width, height and thumbnail. Equal inputs give equal outputs; rows are never dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table, text_slices, utf8

TILE = 576
BLOCKS_WIDE = 24
#: 8184 block rows of 24 blocks: the image's height stays below 65,536 pixels.
MAX_IMAGE_BYTES = 341 * TILE
#: Blocks that are coded or decoded together.
WORK_BYTES = 1 << 19
#: Fixed values of the standard luminance DC table: number of codes of each length 1..16, then symbols.
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
#: One AC code: end of block, the single bit 0.
AC_COUNTS, AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])


@lru_cache(maxsize=64)
def huffman_lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window: the symbol that its leading bits spell and the code's length (0: none)."""
    sym, length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    code = at = 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            low = code << (16 - bits)
            sym[low : low + (1 << (16 - bits))], length[low : low + (1 << (16 - bits))] = s, bits
            code += 1
        at += n
        code <<= 1
    return sym, length


@lru_cache(maxsize=1)
def block_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference -255..255 (at +255): the block's bits (DC code, magnitude, AC end) and their number."""
    sym, length = huffman_lookup(DC_COUNTS, DC_SYMBOLS)
    first = {int(s): int(np.flatnonzero((sym == s) & (length > 0))[0]) for s in range(12)}
    value, bits = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        n = int(length[first[size]])
        code = first[size] >> (16 - n)
        value[d + 255] = (code << size | (d if d >= 0 else d + (1 << size) - 1)) << 1
        bits[d + 255] = n + size + 1
    return value, bits


def header(rows: int) -> bytes:
    """Everything before the entropy-coded data of a grey image of rows x 24 blocks."""
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    return (
        b"\xff\xd8"
        + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
        + segment(0xDB, bytes([0] + [8] * 64))
        + segment(0xC0, struct.pack(">BHHB", 8, rows * 8, BLOCKS_WIDE * 8, 1) + bytes([1, 0x11, 0]))
        + segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS)
        + segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS)
        + segment(0xDD, struct.pack(">H", BLOCKS_WIDE))
        + segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def together(items: list, sizes: list, limit: int = WORK_BYTES):
    """Cut items into runs of about limit, so that one long text needs no more memory than many short ones."""
    for a, b in text_slices([range(n) for n in sizes], limit):
        yield items[a:b]


def encode_payloads(payloads: list) -> list:
    """JPEG streams of payloads (each a positive multiple of TILE bytes)."""
    pieces = [(i, p[a : a + MAX_IMAGE_BYTES]) for i, p in enumerate(payloads) for a in range(0, len(p), MAX_IMAGE_BYTES)]
    streams: list = [[] for _ in payloads]
    for run in together(pieces, [len(p) for _, p in pieces]):
        for (i, _), stream in zip(run, encode_images([p for _, p in run])):
            streams[i].append(stream)
    return [b"".join(s) for s in streams]


def encode_images(pieces: list) -> list:
    """A JPEG stream for each piece of at most MAX_IMAGE_BYTES, all rows coded together."""
    value, bits = block_codes()
    dc = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int32).reshape(-1, BLOCKS_WIDE)
    diff = np.diff(dc, axis=1, prepend=128)
    v, n = value[diff + 255], bits[diff + 255]
    used = n.cumsum(axis=1)
    row_bytes = (used[:, -1] + 7) // 8
    row_start = np.concatenate([[0], np.cumsum(row_bytes)])
    at = used - n + row_start[:-1, None] * 8
    wide = (v << (24 - n - (at & 7))).ravel()
    where = (at >> 3).ravel()
    size = int(row_start[-1]) + 3
    data = sum(np.bincount(where + k, (wide >> (16 - 8 * k)) & 255, size) for k in range(3)).astype(np.uint8)[: size - 3]
    data[row_start[1:] - 1] |= ((1 << (row_bytes * 8 - used[:, -1])) - 1).astype(np.uint8)  # pad with ones
    rows = np.fromiter((len(p) // BLOCKS_WIDE for p in pieces), np.int64, len(pieces))
    last = np.cumsum(rows) - 1
    in_image = np.arange(int(rows.sum())) - np.repeat(last - rows + 1, rows)
    marker = (0xD0 + in_image % 8).astype(np.uint8)
    marker[last] = 0xD9
    step = 1 + (data == 0xFF).astype(np.int64)
    step[row_start[1:] - 1] += 2
    end = np.cumsum(step)
    out = np.zeros(int(end[-1]), np.uint8)
    out[end - step] = data
    row_end = end[row_start[1:] - 1]
    out[row_end - 2], out[row_end - 1] = 0xFF, marker
    image_end = row_end[last]
    result, start = [], 0
    for p, stop in zip(pieces, image_end.tolist()):
        result.append(header(len(p) // BLOCKS_WIDE) + out[start:stop].tobytes())
        start = stop
    return result


class Scan:
    """One image's frame, its scan's layout and its lanes of un-stuffed entropy-coded data."""

    def __init__(self) -> None:
        self.quant: dict[int, int] = {}
        self.tables: dict[int, tuple[bytes, bytes]] = {}
        self.frame: list[tuple[int, int, int, int]] = []
        self.width = self.height = self.interval = 0
        self.lanes: list[np.ndarray] = []
        self.blocks: list[tuple[int, int, int]] = []  # of an MCU: component, DC table, AC table


def parse(media: bytes, at: int = 0) -> tuple[Scan, int]:
    """Parse the image that begins at at; returns it and where it ends. ValueError if it isn't baseline."""
    if media[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    scan, at = Scan(), at + 2
    while True:
        while media[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(media) or media[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = media[at + 1]
        (size,) = struct.unpack_from(">H", media, at + 2)
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                scan.quant[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                body = body[1 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                counts = body[1:17]
                scan.tables[body[0]] = counts, body[17 : 17 + sum(counts)]
                body = body[17 + sum(counts) :]
        elif kind in (0xC0, 0xC1):
            bits, scan.height, scan.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not scan.height or not scan.width:
                raise ValueError("not 8-bit samples")
            scan.frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= kind <= 0xCF and kind != 0xCC:
            raise ValueError("not a baseline frame")
        elif kind == 0xDD:
            (scan.interval,) = struct.unpack_from(">H", body)
        elif kind == 0xDA:
            break
    if not scan.frame or body[0] != len(scan.frame):
        raise ValueError("not one interleaved scan")
    chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    alone = len(scan.frame) == 1
    for k, (c, h, v, _) in enumerate(scan.frame):
        scan.blocks += [(k, chosen[c] >> 4, 0x10 | chosen[c] & 15)] * (1 if alone else h * v)
    data = np.frombuffer(media, np.uint8, offset=at)
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    ends = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    stop = int(ends[0]) if len(ends) else len(data)
    ff, after = ff[ff < stop], after[ff < stop]
    keep = np.ones(stop, bool)
    keep[ff[after == 0] + 1] = False
    cuts = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[cuts] = keep[cuts + 1] = False
    ends = np.cumsum(keep)
    edges = [0, *(ends[cuts].tolist()), int(ends[-1]) if stop else 0]
    kept = data[:stop][keep]
    scan.lanes = [kept[a:b] for a, b in zip(edges, edges[1:])]
    return scan, at + stop + 2


def mcu_grid(scan: Scan) -> tuple[int, int]:
    """MCUs across and down."""
    h, v = (1, 1) if len(scan.frame) == 1 else (max(c[1] for c in scan.frame), max(c[2] for c in scan.frame))
    return -(-scan.width // (8 * h)), -(-scan.height // (8 * v))


def decode_lanes(lanes: list, mcus: np.ndarray, blocks: list, tables: dict) -> np.ndarray:
    """DC values [MCU, block of the MCU, lane] of lanes that share a layout, all lanes in step."""
    sizes = np.fromiter((len(x) for x in lanes), np.int64, len(lanes))
    start = np.concatenate([[0], np.cumsum(sizes + 8)])
    flat = np.full(int(start[-1]) + 8, 0xFF, np.uint8)
    whole = np.concatenate(lanes) if lanes else np.zeros(0, np.uint8)
    flat[np.arange(len(whole)) + np.repeat(8 * np.arange(len(lanes)), sizes)] = whole
    wide = flat.astype(np.uint32)
    window = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    end = (start[1:] - 1) * 8
    pos = start[:-1] * 8
    components = 1 + max(b[0] for b in blocks)
    pred = np.zeros((components, len(lanes)), np.int32)
    out = np.zeros((int(mcus.max(initial=0)), len(blocks), len(lanes)), np.int16)
    luts = {t: huffman_lookup(*tables[t]) for b in blocks for t in b[1:]}
    uneven = bool((mcus != out.shape[0]).any())

    def peek(p):
        return (window[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF

    for m in range(out.shape[0]):
        alive = np.flatnonzero(mcus > m) if uneven else slice(None)
        p, last = pos[alive], end[alive]
        for j, (c, dc, ac) in enumerate(blocks):
            sym, length = luts[dc]
            w = peek(p)
            size = sym[w]
            p = p + length[w]
            v = (peek(p) >> (16 - size).astype(np.uint32)).astype(np.int32)
            v -= np.where(v < (1 << size >> 1), (1 << size) - 1, 0)
            p = np.minimum(p + size, last)
            pred[c, alive] += v
            out[m, j, alive] = pred[c, alive]
            sym, length = luts[ac]
            w = peek(p)
            s = sym[w]
            p = p + length[w]
            if s.any():  # not all lanes end their block at once: step through AC symbols
                p = np.minimum(p + (s & 15), last)
                k = np.where((s & 15 == 0) & (s != 0xF0), 64, 2 + (s >> 4))
                open_ = np.flatnonzero(k < 64)
                while len(open_):
                    q = p[open_]
                    w = peek(q)
                    s, n = sym[w], length[w]
                    p[open_] = np.minimum(q + n + (s & 15), last[open_])
                    k[open_] = np.where((n == 0) | (s & 15 == 0) & (s != 0xF0), 64, k[open_] + 1 + (s >> 4))
                    open_ = open_[k[open_] < 64]
        pos[alive] = np.minimum(p, last)
    return out


def luminance(scan: Scan, dc: np.ndarray) -> np.ndarray:
    """The thumbnail, one pixel a block, of a scan's DC values [MCU, block]."""
    across, down = mcu_grid(scan)
    h, v = (1, 1) if len(scan.frame) == 1 else scan.frame[0][1:3]
    mine = [j for j, b in enumerate(scan.blocks) if b[0] == 0]
    grid = dc[: across * down, mine].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    most_h, most_v = (1, 1) if len(scan.frame) == 1 else (max(c[1] for c in scan.frame), max(c[2] for c in scan.frame))
    rows, cols = -(-scan.height * v // (8 * most_v)), -(-scan.width * h // (8 * most_h))
    level = np.floor(grid[:rows, :cols].astype(np.int64) * scan.quant.get(scan.frame[0][3], 1) / 8 + 0.5) + 128
    return np.clip(level, 0, 255).astype(np.uint8)


def decode_media(medias: list) -> list:
    """For each media value the list of its images as (width, height, thumbnail), or None if it isn't baseline JPEG."""
    result: list = []
    layouts: dict = {}
    for media in medias:
        scans, at = [], 0
        try:
            while at < len(media or b""):
                scan, at = parse(media, at)
                scans.append(scan)
                tables = {t: scan.tables[t] for b in scan.blocks for t in b[1:]}
                layouts.setdefault((tuple(scan.blocks), tuple(sorted(tables.items()))), []).append(scan)
        except (ValueError, IndexError, KeyError, struct.error):
            scans = []
        result.append(scans)
    decoded = {}
    runs = [(key, run) for key, scans in layouts.items() for run in together(scans, [scan.width * scan.height // 64 for scan in scans])]
    for (blocks, tables), scans in runs:
        lanes, mcus, spans = [], [], []
        for scan in scans:
            across, down = mcu_grid(scan)
            total, each = across * down, scan.interval or across * down
            need = -(-total // each)
            own = (scan.lanes + [np.zeros(0, np.uint8)] * need)[:need]
            spans.append((len(lanes), len(lanes) + need))
            lanes += own
            mcus += [min(each, total - k * each) for k in range(need)]
        dc = decode_lanes(lanes, np.array(mcus, np.int64), list(blocks), dict(tables))
        counts = np.array(mcus)
        for scan, (a, b) in zip(scans, spans):
            part = dc[:, :, a:b].transpose(2, 0, 1)
            full = part.reshape(-1, len(blocks)) if (counts[a:b] == dc.shape[0]).all() else np.concatenate([x[:n] for x, n in zip(part, counts[a:b])])
            decoded[id(scan)] = scan.width, scan.height, luminance(scan, full)
    return [[decoded[id(s)] for s in scans] or None for scans in result]


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64-bit difference hash: mean grey of 8 x 9 cells, a bit is set where a cell is darker than the next."""
    rows = np.linspace(0, thumb.shape[0], 9).astype(int)[:-1]
    cols = np.linspace(0, thumb.shape[1], 10).astype(int)[:-1]
    if thumb.shape[0] < 8 or thumb.shape[1] < 9:
        cells = thumb[np.ix_(rows, cols)].astype(float)
    else:
        total = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), rows, 0), cols, 1)
        cells = total / np.outer(np.diff([*rows, thumb.shape[0]]), np.diff([*cols, thumb.shape[1]]))
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width long, height long, thumbnail binary, feature string"


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (TILE - len(text) if not text else -len(text) % TILE)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, media): each whole text as a baseline JPEG."""

    def encode(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        for batch in batches:
            texts, ids = utf8(batch.column(1)), batch.column(0)
            for a, b in text_slices(texts):
                media = encode_payloads([padded(t) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(encode, MEDIA_SCHEMA)


def media_features(media: DataFrame, thumbnails: bool = True) -> DataFrame:
    """(doc_id, n_bytes, media) to dimensions, DC-only luminance thumbnail and hashes, read from the stored bytes."""

    def decode(batches):
        names = [f.split()[0] for f in FEATURE_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        schema = pa.schema(list(zip(names, kinds)))
        for batch in batches:
            medias, ids, sizes = batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_slices([m or b"" for m in medias]):
                rows = []
                for i, images in zip(range(a, b), decode_media(medias[a:b])):
                    m = medias[i] or b""
                    stored = [len(m), hashlib.sha256(m).hexdigest()]
                    if not images:
                        rows.append([ids[i], sizes[i], None, None, None, *stored, None, None, None, None])
                        continue
                    thumb = images[0][2] if len(images) == 1 or len({t.shape[1] for *_, t in images}) > 1 else np.concatenate([t for *_, t in images])
                    payload = b"".join(t.tobytes() for *_, t in images)
                    w, h = images[0][0], sum(x[1] for x in images)
                    rows.append([ids[i], sizes[i], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, w, h, thumb.tobytes() if thumbnails else None, f"{w}x{h}:{thumbnail_hash(thumb)}"])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, FEATURE_SCHEMA)


def op10_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a baseline JPEG and read back."""
    return media_features(store_texts(table(spark, sf_dir, "documents")), thumbnails=False).drop("thumbnail")


QUERIES = {"op10_media_jpeg": op10_media_jpeg}
