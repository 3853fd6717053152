"""GIF media columns.

``decode`` reads GIF87a/GIF89a bytes: screen and palettes, the LZW code streams of every image
(interlaced or not), and plays them by the transparency and disposal rules.  Each timed frame becomes
a struct with the rectangle it drew, its delay, and the colours of that rectangle on the screen after
drawing; a histogram of colours (four levels a channel, 64 bins) stands beside them.  ``encode`` writes
bytes losslessly as 8-bit samples of a grey palette, ``WIDTH`` pixels a row and ``ROWS`` rows a frame.

Code positions of an LZW stream depend on the number of codes since the last clear code alone, so the
codes of a run are cut out of the bits at once with numpy; only the string table is a loop, a step for
each code.

Scale: maps without a shuffle; a row is worked on alone, memory is bounded by the largest media value.
Edge cases: null bytes give null columns; empty bytes and broken files give no frames and the reason in
``error``; a stream that ends early leaves the pixels it lacks undrawn; equal bytes have equal columns;
an empty table gives an empty result; ``out`` columns that exist already are an error.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty

WIDTH, ROWS, DELAY = 576, 100, 10  # DELAY in hundredths of a second
PAD = 255
GREY = bytes(v for v in range(256) for _ in range(3))
TOP = 4096
PIXELS = 1 << 26  # of a screen, at most

FRAME = "struct<left:int,top:int,width:int,height:int,delay_ms:int,disposal:int,transparent:int,rgb:binary>"


def _widths(least: int, most: int = 2 * TOP) -> np.ndarray:
    """Bits of the ``most`` first codes after a clear code; once the table is full they stay as they are."""
    # The reader adds an entry with each code but the first; codes grow when the table reaches a power of two.
    entries = np.minimum(np.maximum(np.arange(most) - 1, 0) + (1 << least) + 2, TOP - 1)
    return np.maximum(np.floor(np.log2(entries)).astype(np.int64) + 1, least + 1)


def lzw_decode(data: bytes, least: int, pixels: int) -> bytes:
    """Indices of a GIF code stream; at most ``pixels`` of them."""
    clear, stop = 1 << least, (1 << least) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    bits = 8 * len(data)
    widths = _widths(least)
    starts = np.concatenate(([0], np.cumsum(widths)))
    out, got, at = [], 0, 0
    while at < bits and got < pixels:
        while True:
            n = int(np.searchsorted(starts, bits - at, "right")) - 1  # whole codes left, were there no clear code
            if n <= 0:
                return b"".join(out)[:pixels]
            n = min(n, len(widths))
            off = at + starts[:n]
            k = off >> 3
            codes = (((raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) >> (off & 7).astype(np.uint32)) & ((1 << widths[:n]) - 1).astype(np.uint32)).astype(np.int32)
            ends = np.flatnonzero((codes == clear) | (codes == stop))
            if len(ends) or n < len(widths) or n >= pixels:
                break
            # A full table may stay in use: the run lasts until the next clear or end code.
            widths = _widths(least, 4 * len(widths))
            starts = np.concatenate(([0], np.cumsum(widths)))
        m = int(ends[0]) if len(ends) else n
        # With code i the table gets the string of code i - 1 and one more byte; no later entry can be asked for.
        wrong = np.flatnonzero(codes[:m] - (clear + 2) >= np.arange(m))
        part = _strings(codes[: wrong[0] if len(wrong) else m], clear, pixels - got)
        out.append(part)
        got += len(part)
        if len(wrong) or not len(ends) or codes[m] == stop:
            break
        at += int(starts[m + 1])
    return b"".join(out)[:pixels]


def _strings(codes: np.ndarray, clear: int, most: int) -> bytes:
    """The indices of the codes between two clear codes, up to the code that passes ``most``.

    A code of the table repeats what an earlier code stood for, and the index after it: a copy from
    where that code's output starts.  Lengths and copied places come from following such references,
    doubling the step each time, instead of code by code."""
    if not len(codes):
        return b""
    of = np.where(codes < clear, -1, codes - (clear + 2))  # the code that a code repeats
    length, ref = np.ones(len(codes), np.int32), of.copy()
    while len(far := np.flatnonzero(ref >= 0)):
        to = ref[far]
        length[far] += length[to]
        ref[far] = ref[to]
    start = np.cumsum(length) - length
    n = int(np.searchsorted(start, most))  # codes refer to earlier ones only
    codes, of, length, start = codes[:n], of[:n], length[:n], start[:n]
    back = np.where(of < 0, 0, start - start[of]).astype(np.int32)
    place = np.arange(int(length.sum()), dtype=np.int32) - np.repeat(back, length)
    while not np.array_equal(further := place[place], place):
        place = further
    value = np.zeros(len(place), np.uint8)
    value[start] = np.where(of < 0, codes, 0)
    return value[place].tobytes()


def lzw_encode(data: bytes, least: int = 8) -> bytes:
    """A GIF code stream of ``data``; the table starts anew when it is full."""
    clear, stop = 1 << least, (1 << least) + 1
    runs, codes = [], []
    # A node of the table: the nodes of its longer strings by byte, its own code under -1.
    root = {b: {-1: b} for b in range(clear)} | {-1: clear}
    node, nxt = root, clear + 2
    for b in data:
        if b in node:
            node = node[b]
            continue
        codes.append(node[-1])
        if nxt < TOP:
            node[b] = {-1: nxt}
            nxt += 1
        else:
            codes.append(clear)
            runs.append(codes)
            codes, nxt = [], clear + 2
            root = {x: {-1: x} for x in range(clear)} | {-1: clear}
        node = root[b]
    if node is not root:
        codes.append(node[-1])
    codes.append(stop)
    runs.append(codes)
    widths = _widths(least)
    # The first code of all clears the table; it has the least width.
    flat = np.array([clear, *(c for r in runs for c in r)], np.uint16)
    wide = np.concatenate([widths[:1], *(widths[: len(r)] for r in runs)])
    # Codes of one width after another: each is at most 12 bits, laid out from its lowest bit.
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < wide[:, None]], bitorder="little").tobytes()


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def gif_of(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames hold ``samples``, a whole number of rows, as grey palette indices."""
    step, total = width * rows, len(samples) // width
    head = b"GIF89a" + width.to_bytes(2, "little") + min(rows, total).to_bytes(2, "little") + b"\xf7\0\0" + GREY
    parts = [head]
    for i in range(0, len(samples), step):
        part = samples[i : i + step]
        parts.append(b"\x21\xf9\x04\x04" + delay.to_bytes(2, "little") + b"\0\0")
        parts.append(b"\x2c\0\0\0\0" + width.to_bytes(2, "little") + (len(part) // width).to_bytes(2, "little") + b"\0\x08" + _blocks(lzw_encode(part)))
    return b"".join(parts) + b"\x3b"


EXPANSION = 4096  # samples that a byte of codes stands for at most, generously


def frames_of(data: bytes):
    """(frame fields, indices' rectangle as RGB array) of each image, as played."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    word = lambda i: int.from_bytes(data[i : i + 2], "little")
    W, H, flags, ground = word(6), word(8), data[10], data[11]
    if W * H > PIXELS:  # the header is not to be trusted with memory
        raise ValueError(f"screen of over {PIXELS} pixels")
    at = 13

    def palette(flags):
        nonlocal at
        n = 3 << ((flags & 7) + 1)
        p = np.zeros((256, 3), np.uint8)
        raw = np.frombuffer(data[at : at + n], np.uint8)
        p[: len(raw) // 3] = raw[: len(raw) // 3 * 3].reshape(-1, 3)
        at += n
        return p

    def blocks():
        nonlocal at
        got = []
        while at < len(data) and data[at]:
            got.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        at += 1
        return b"".join(got)

    shared = palette(flags) if flags & 0x80 else None
    back = shared[ground] if shared is not None else np.zeros(3, np.uint8)
    screen = np.broadcast_to(back, (H, W, 3)).copy()
    disposal = delay = drawn_so_far = 0
    clear = -1
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                clear = body[3] if body[0] & 1 else -1
        elif kind == 0x2C:
            if at + 9 > len(data):
                raise ValueError("cut off in an image")
            left, top, w, h, bits = word(at), word(at + 2), word(at + 4), word(at + 6), data[at + 8]
            at += 9
            drawn_so_far += w * h
            if w * h > PIXELS or drawn_so_far > PIXELS + EXPANSION * len(data):
                raise ValueError(f"image of over {PIXELS} pixels, or images of more than their codes can hold")
            colours = palette(bits) if bits & 0x80 else shared
            least = data[at] if at < len(data) else 0
            at += 1
            stream = blocks()
            if colours is None or not 1 <= least <= 8:
                raise ValueError("no palette or code size")
            index = np.frombuffer(lzw_decode(stream, least, w * h), np.uint8)
            drawn = np.arange(w * h) < len(index) if len(index) < w * h else np.ones(w * h, bool)
            index = np.concatenate((index, np.zeros(w * h - len(index), np.uint8)))
            if clear >= 0:
                drawn &= index != clear
            index, drawn = index.reshape(h, w), drawn.reshape(h, w)
            if bits & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                place = np.empty(h, np.int64)
                place[order] = np.arange(h)
                index, drawn = index[place], drawn[place]
            before = screen.copy() if disposal == 3 else None
            area = screen[top : top + h, left : left + w]  # what lies beyond the screen isn't shown
            seen = drawn[: area.shape[0], : area.shape[1]]
            now = colours.take(index[: area.shape[0], : area.shape[1]], axis=0)
            if seen.all():
                area[...] = now
            else:
                area[seen] = now[seen]
            yield (left, top, area.shape[1], area.shape[0], 10 * delay, disposal, clear), area.copy()
            if disposal == 2:
                area[...] = back
            elif disposal == 3:
                screen = before
            disposal = delay = 0
            clear = -1
        else:
            raise ValueError("unknown block")


def histogram(rgb: np.ndarray) -> np.ndarray:
    """Counts of colours by the upper two bits of red, green, blue."""
    q = rgb.reshape(-1, 3) >> 6
    return np.bincount((q[:, 0] << 4 | q[:, 1] << 2 | q[:, 2]).astype(np.int64), minlength=64)


def _mapped(df: DataFrame, source: str, schema: str, work) -> DataFrame:
    """Adds columns of ``work(bytes or None)``, a few rows of media at a time."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    if clash := set(names) & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    kept = df.schema.simpleString()[len("struct<") : -1]
    kinds = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = list(to_arrow_schema(kinds))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                made = list(zip(*(work(v.as_py()) for v in part.column(part.schema.get_field_index(source))), strict=True))
                yield pa.RecordBatch.from_arrays(list(part.columns) + [pa.array(x, f.type) for x, f in zip(made, fields, strict=True)], names=list(part.schema.names) + names)

    return df.mapInArrow(run, f"{kept},{schema}")


def encode(df: DataFrame, samples: str, out: str = "media", width: int = WIDTH, rows: int = ROWS) -> DataFrame:
    """``df`` with column ``samples`` (bytes, a whole number of rows of ``width``) written as GIF."""
    return _mapped(df, samples, f"{out} binary", lambda v: (None if v is None else gif_of(v, width, rows),))


def decode(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with ``frames``, their colour ``histogram`` and the ``error`` that ended reading, if any."""

    def work(v):
        if v is None:
            return None, None, None
        got, total, error = [], np.zeros(64, np.int64), None
        try:
            for (left, top, w, h, ms, disposal, clear), rgb in frames_of(v):
                got.append({"left": left, "top": top, "width": w, "height": h, "delay_ms": ms, "disposal": disposal, "transparent": clear, "rgb": rgb.tobytes()})
                total += histogram(rgb)
        except ValueError as e:
            error = str(e)
        return got, total.tolist(), error

    return _mapped(df, media, f"frames array<{FRAME}>, histogram array<bigint>, error string", work)


def read_back(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with ``samples``, the first channel of all frames in order, ``n_frames`` and the ``histogram``.

    The frames are played as in ``decode``; their pixels stay in the task."""

    def work(v):
        total, parts = np.zeros(64, np.int64), []
        for _, rgb in frames_of(v):
            parts.append(rgb[:, :, 0].tobytes())
            total += histogram(rgb)
        return b"".join(parts), len(parts), total.tolist()

    return _mapped(df, media, "samples binary, n_frames int, histogram array<bigint>", work)


def padded(text, width: int = WIDTH):
    """UTF-8 bytes with bytes 255 appended up to a positive multiple of ``width``."""
    raw = F.encode(text, "UTF-8")
    n = F.octet_length(text)
    more = F.greatest(F.ceil(n / width), F.lit(1)) * width - n
    return F.concat(raw, F.unhex(F.repeat(F.lit(f"{PAD:02X}"), more.cast("int"))))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), padded(F.col("text")).alias("payload"))
    seen = read_back(encode(rows, "payload").drop("payload"))
    size = F.octet_length("samples")
    used = F.filter(F.transform("histogram", lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda x: x["n"] > 0)
    return seen.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("samples"), F.lit(-32), F.lit(32))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.col("n_frames").cast("string"), F.lit(";"), F.array_join(F.transform(used, lambda x: F.concat_ws(":", x["i"].cast("string"), x["n"].cast("string"))), ",")).alias("feature"),
    )
