"""Media columns: signature sniffing, validation, type correction and carving.

An Aho-Corasick automaton locates magic bytes and end marks anywhere in a stored
value in one pass, a validator per format confirms structure and lengths, the
declared type is corrected to what the first bytes prove, and confirmed media
inside a value are carved out as spans. End marks are looked up, not searched, so
many openings without an end cost no more than their number.

Lengths are confirmed by: RIFF chunks; PNG chunks with their checksums; JPEG
segments up to the first end mark after the scan begins; GIF blocks; the last
end mark of a PDF, before the next one begins, whose cross reference is where it
says; the ZIP end record whose directory begins where it says and leads back to
this start; gzip's own stream; FLAC blocks and frames with both their checksums up to the
stated number of samples; Ogg pages with their checksums; MP4 boxes. Chains that several openings
lead to are walked once, so crafted values cost no more than their length for these formats.

Defined results: a null value counts as empty; an empty value has no type
(`empty`); a magic whose structure does not hold is ignored; overlapping
confirmed spans are all reported, in order of start, then length, but for Ogg pages and MP4 boxes that continue
a stream; equal values give equal results.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framewright.llm.common import Texts, batch_of, map_batches

RATE = 8000  # samples a second of the stored audio
#: Magic bytes of the formats, at their place from the start of a file.
MAGICS = {
    b"RIFF": ("riff", 0),
    b"\x89PNG\r\n\x1a\n": ("png", 0),
    b"\xff\xd8\xff": ("jpeg", 0),
    b"GIF87a": ("gif", 0),
    b"GIF89a": ("gif", 0),
    b"%PDF-": ("pdf", 0),
    b"PK\x03\x04": ("zip", 0),
    b"\x1f\x8b\x08": ("gzip", 0),
    b"fLaC": ("flac", 0),
    b"OggS": ("ogg", 0),
    b"ftyp": ("mp4", 4),
}


#: Marks at or near the end of a file.
END_MARKS = {b"%%EOF": "pdf", b"PK\x05\x06": "zip", b"\xff\xd9": "jpeg"}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, (kind, place) in MAGICS.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic) + place, True))
    for mark, kind in END_MARKS.items():
        found.add_word(mark.decode("latin-1"), (kind, len(mark), False))
    found.make_automaton()
    return found


class Marks:
    """Where media may begin and end in a value."""

    def __init__(self, value: bytes, found: ahocorasick.Automaton):
        self.openings: list[tuple[str, int]] = []
        self.ends: dict[str, list[int]] = {kind: [] for kind in END_MARKS.values()}
        for last, (kind, back, opens) in found.iter(value.decode("latin-1")):
            at = last + 1 - back
            if not opens:
                self.ends[kind].append(at)
            elif at >= 0:
                self.openings.append((kind, at))
        self.pdfs = [at for kind, at in self.openings if kind == "pdf"]
        #: start of an archive that an end record leads back to -> the last such record
        self.archives: dict[int, int] = {}
        for end in self.ends["zip"]:
            if end + 22 <= len(value):
                size, start = struct.unpack_from("<II", value, end + 12)
                self.archives[end - size - start] = end
        # what chains of JPEG segments, GIF blocks and data, FLAC frames and MP4 boxes have come to, by place: none is walked twice
        self.segments: dict[int, int | None] = {}
        self.blocks: dict[int, int | None] = {}
        self.data: dict[int, int] = {}
        self.frames: dict[tuple[int, bool], int | None] = {}
        self.boxes: dict[int, tuple[int, int]] = {}

    def after(self, kind: str, place: int) -> int | None:
        """The first end mark at or after a place."""
        k = bisect.bisect_left(self.ends[kind], place)
        return self.ends[kind][k] if k < len(self.ends[kind]) else None


def _riff(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end = at + 8 + size + (size & 1)
    if form not in (b"WAVE", b"AVI ", b"WEBP") or size < 4 or at + 8 + size > len(b):
        return None
    place, names = at + 12, []
    while place + 8 <= at + 8 + size:
        name, length = struct.unpack_from("<4sI", b, place)
        if place + 8 + length > at + 8 + size:
            return None
        names.append(name)
        place += 8 + length + (length & 1)
    if form == b"WAVE" and not (b"fmt " in names and b"data" in names):
        return None
    return {b"WAVE": "wav", b"AVI ": "avi", b"WEBP": "webp"}[form], min(end, len(b)) - at


def _png(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    place = at + 8
    while place + 12 <= len(b):
        length, name = struct.unpack_from(">I4s", b, place)
        if place + 12 + length > len(b) or zlib.crc32(b[place + 4 : place + 8 + length]) != struct.unpack_from(">I", b, place + 8 + length)[0]:
            return None
        if place == at + 8 and name != b"IHDR":
            return None
        place += 12 + length
        if name == b"IEND":
            return "png", place - at
    return None


def _jpeg(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    walked, place, end = [], at + 2, None
    while place + 4 <= len(b) and b[place] == 0xFF:
        if place in marks.segments:
            end = marks.segments[place]
            break
        walked.append(place)
        marker, length = b[place + 1], struct.unpack_from(">H", b, place + 2)[0]
        if length < 2:
            break
        place += 2 + length
        if marker == 0xDA:
            end = marks.after("jpeg", place)
            break
    marks.segments.update(dict.fromkeys(walked, end))
    return ("jpeg", end + 2 - at) if end is not None else None


def _colours(flags: int) -> int:
    """Bytes of a GIF colour table."""
    return 3 << ((flags & 7) + 1) if flags & 0x80 else 0


def _data_end(b: bytes, place: int, known: dict[int, int]) -> int:
    """Where the data blocks that begin at a place end; `known` keeps what has been walked."""
    walked = []
    while place not in known and place < len(b) and b[place]:
        walked.append(place)
        place += 1 + b[place]
    end = known.get(place, place + 1)
    known.update(dict.fromkeys(walked, end))
    return end


def _gif(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    if at + 13 > len(b) or 0 in struct.unpack_from("<HH", b, at + 6):
        return None
    walked, place, end = [], at + 13 + _colours(b[at + 10]), None
    while place < len(b):
        if place in marks.blocks:
            end = marks.blocks[place]
            break
        walked.append(place)
        if b[place] == 0x3B:
            end = place + 1
            break
        if b[place] == 0x2C and place + 10 <= len(b):
            place += 11 + _colours(b[place + 9])
        elif b[place] == 0x21:
            place += 2
        else:
            break
        place = _data_end(b, place, marks.data)
    marks.blocks.update(dict.fromkeys(walked, end))
    return ("gif", end - at) if end is not None else None


_startxref = re.compile(rb"startxref[\x00\t\n\x0c\r ]+(\d{1,12})[\x00\t\n\x0c\r ]+\Z")
_reference = re.compile(rb"\s{0,64}(xref\b|\d{1,12}\s{1,64}\d{1,12}\s{1,64}obj\b)")


def _pdf(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    if at + 8 > len(b) or not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"."):
        return None
    k = bisect.bisect_right(marks.pdfs, at)
    limit = marks.pdfs[k] if k < len(marks.pdfs) else len(b)
    first, last = (bisect.bisect_left(marks.ends["pdf"], x) for x in (at, limit))
    ends = marks.ends["pdf"]
    for k in range(last - 1, first - 1, -1):  # the last mark whose reference holds; each mark belongs to one opening
        end, before = ends[k], max(at, ends[k - 1] if k else at)
        said = _startxref.match(b, found, end) if (found := b.rfind(b"startxref", before, end)) >= 0 else None
        if said and (place := at + int(said[1])) < end and _reference.match(b, place, end):
            return "pdf", end + 5 - at
    return None


def _zip(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    end = marks.archives.get(at)
    if end is None or at + 30 > len(b):
        return None
    start = at + struct.unpack_from("<I", b, end + 16)[0]
    if start != end and b[start : start + 4] != b"PK\x01\x02":
        return None
    stop = end + 22 + struct.unpack_from("<H", b, end + 20)[0]
    return ("zip", stop - at) if stop <= len(b) else None


def _gzip(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    worker = zlib.decompressobj(31)
    place = at
    try:
        while not worker.eof:
            block = b[place : place + (1 << 12)]
            if not block:
                return None
            place += len(block)
            while block and not worker.eof:
                worker.decompress(block, 1 << 20)
                block = worker.unconsumed_tail
    except zlib.error:
        return None
    return "gzip", place - len(worker.unused_data) - at


def crc_table(polynomial: int, bits: int) -> list[int]:
    """Checksums of single bytes, highest bit first."""
    top, mask, table = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ polynomial if c & top else c << 1) & mask
        table.append(c)
    return table


CRC8, CRC16, CRC32 = crc_table(0x07, 8), crc_table(0x8005, 16), crc_table(0x04C11DB7, 32)


def _frame_end(b: bytes, place: int, head: tuple[int, int], last: bool, most: int) -> int | None:
    """Where the frame's checksum, itself included, is none and another frame or the end follows; a frame has `most` bytes at most."""
    c, end = 0, place
    for byte in memoryview(b)[place : place + most]:
        c = ((c << 8) & 0xFFFF) ^ CRC16[(c >> 8) ^ byte]
        end += 1
        if not c and end >= place + head[1] + 3 and (last or _frame(b, end)):
            return end
    return None


def _frame(b: bytes, at: int) -> tuple[int, int] | None:
    """(samples, length of the header) of a FLAC frame whose header's checksum holds."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or b[at + 2] >> 4 == 0 or b[at + 2] & 15 == 15 or b[at + 3] >> 4 > 10 or b[at + 3] & 1:
        return None
    size, rate, lead = b[at + 2] >> 4, b[at + 2] & 15, b[at + 4]
    coded = 1 if lead < 0x80 else 8 - (~lead & 0xFF).bit_length()  # of the frame's number, as in UTF-8
    if not 1 <= coded <= 7:
        return None
    place = at + 4 + coded
    if size == 1:
        samples = 192
    elif size <= 5:
        samples = 576 << (size - 2)
    elif size in (6, 7):
        samples = int.from_bytes(b[place : place + size - 5], "big") + 1
        place += size - 5
    else:
        samples = 256 << (size - 8)
    place += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    c = 0
    for byte in b[at:place]:
        c = CRC8[c ^ byte]
    return (samples, place + 1 - at) if place < len(b) and c == b[place] else None


def _flac(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    place, total, last, wide = at + 4, None, False, 0
    while not last:
        if place + 4 > len(b):
            return None
        last, kind, length = bool(b[place] & 0x80), b[place] & 0x7F, int.from_bytes(b[place + 1 : place + 4], "big")
        if kind == 127 or place + 4 + length > len(b) or (total is None) != (kind == 0) or (kind == 0 and length != 34):
            return None
        if kind == 0:
            total = int.from_bytes(b[place + 17 : place + 22], "big") & (2**36 - 1)
            facts = int.from_bytes(b[place + 14 : place + 18], "big") >> 4
            wide = (facts >> 5 & 7) + 1, (facts & 31) + 2  # channels, bits of a sample and its difference
        place += 4 + length
    done = 0
    while done < total or not total:  # 0: the number of samples is not stated
        head = _frame(b, place)
        if not head:
            break
        last = done + head[0] >= (total or 1)
        if (place, last) not in marks.frames:  # openings that lead to the same frame look for its end once
            marks.frames[place, last] = _frame_end(b, place, head, last, head[1] + 2 + wide[0] * (8 + (head[0] * wide[1] + 7) // 8))
        end = marks.frames[place, last]
        if end is None:
            break
        done, place = done + head[0], end
    return ("flac", place - at) if done and done >= total else None


def _ogg(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    place = at
    while place + 27 <= len(b) and b[place : place + 5] == b"OggS\x00" and b[place + 5] < 8:
        n = b[place + 26]
        if place + 27 + n > len(b):
            break
        end = place + 27 + n + sum(b[place + 27 : place + 27 + n])
        if end > len(b):
            break
        c = 0
        for byte in b[place : place + 22] + bytes(4) + b[place + 26 : end]:
            c = ((c << 8) & 0xFFFFFFFF) ^ CRC32[(c >> 24) ^ byte]
        if c != struct.unpack_from("<I", b, place + 22)[0]:
            break
        place = end
    return ("ogg", place - at) if place > at else None


def _mp4(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    walked, place = [], at
    while place not in marks.boxes and place + 8 <= len(b):
        size, name = struct.unpack_from(">I4s", b, place)
        if size < 8 or place + size > len(b) or not name.replace(b" ", b"a").isalnum():
            break
        walked.append(place)
        place += size
    stop, boxes = marks.boxes.get(place, (place, 0))  # a chain that another one has walked
    for place in reversed(walked):
        boxes += 1
        marks.boxes[place] = stop, boxes
    return ("mp4", stop - at) if boxes >= 2 else None


VALIDATORS = {"riff": _riff, "png": _png, "jpeg": _jpeg, "gif": _gif, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "flac": _flac, "ogg": _ogg, "mp4": _mp4}


def sniff(value: bytes, found: ahocorasick.Automaton | None = None) -> list[tuple[int, int, str]]:
    """Confirmed media of a value: (start, length, kind), by start and length."""
    marks, spans, ogg = Marks(value, found or automaton()), [], 0
    for kind, at in marks.openings:
        if (kind == "ogg" and at < ogg) or (kind == "mp4" and at in marks.boxes):
            continue  # a page, or a box, of the stream before it
        if ok := VALIDATORS[kind](value, at, marks):
            spans.append((at, ok[1], ok[0]))
            ogg = at + ok[1] if kind == "ogg" else ogg
    return sorted(spans)


def corrected(declared: str | None, spans: list[tuple[int, int, str]], value: bytes) -> str:
    """The type that the value's first bytes prove, else the declared one, else binary."""
    if not value:
        return "empty"
    return next((kind for at, _, kind in spans if at == 0), declared or "binary")


def payload(text: bytes) -> bytes:
    """The text and bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (64 if not text else 0))


def store(samples: bytes) -> bytes:
    """Lossless audio of one 8-bit channel."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    pad = b"\0" * (len(samples) & 1)
    body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + pad
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def load(stored: bytes, span: tuple[int, int, str]) -> bytes:
    """The samples of the confirmed audio at `span`."""
    at, length, kind = span
    if kind != "wav":
        raise ValueError(f"not stored audio: {kind}")
    place = at + 12
    while place + 8 <= at + length:
        name, size = struct.unpack_from("<4sI", stored, place)
        if name == b"data":
            return stored[place + 8 : place + 8 + size]
        place += 8 + size + (size & 1)
    raise ValueError("no data chunk")


_squares = (np.arange(256, dtype=np.int64) - 128) ** 2


def features(samples: bytes) -> dict[str, int]:
    """Whole-number features of 8-bit samples: mean square around 128, peak, and crossings of 128."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    above = np.frombuffer(samples, np.uint8) >= 128
    used = np.flatnonzero(counts)
    return {
        "energy": int((counts * _squares).sum() // max(1, len(samples))),
        "peak": int(max(abs(used[0] - 128), abs(used[-1] - 128))) if len(used) else 0,
        "crossings": int(np.count_nonzero(above[1:] != above[:-1])),
    }


SNIFF_SCHEMA = "declared string, detected string, spans array<struct<start: bigint, length: bigint, kind: string>>"


def sniff_column(df: DataFrame, id_col: str, value_col: str, declared_col: str | None = None) -> DataFrame:
    """(id, declared, detected, spans) of a binary or text column."""
    columns = [id_col, value_col] + ([declared_col] if declared_col else [])
    found = automaton()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, rows = Texts(batch.column(1)), batch.column(2).to_pylist() if declared_col else [None] * batch.num_rows
        spans = [sniff(values.text(i), found) for i in range(len(values))]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("kind", pa.string())]))
        return batch_of(
            [id_col, "declared", "detected", "spans"],
            [
                batch.column(0),
                pa.array(rows, pa.string()),
                pa.array([corrected(d, s, values.text(i)) for i, (d, s) in enumerate(zip(rows, spans, strict=True))], pa.string()),
                pa.array([[dict(zip(("start", "length", "kind"), x, strict=True)) for x in s] for s in spans], kind),
            ],
        )

    id_type = dict(df.dtypes)[id_col]
    return map_batches(df.select(*columns), run, f"`{id_col}` {id_type}, {SNIFF_SCHEMA}")


ROUND_TRIP = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def round_trip(text: bytes, found: ahocorasick.Automaton) -> tuple:
    """Store a text as media, sniff the stored form, read it back and describe it."""
    stored = store(payload(text))
    spans = sniff(stored, found)
    back = load(stored, spans[0])
    inside = [s for s in spans[1:]]
    said = {"type": corrected("application/octet-stream", spans, stored), "carved": "+".join(f"{k}@{a - 44}:{n}" for a, n, k in inside) or "none"} | features(back)
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), ";".join(f"{k}={v}" for k, v in said.items())


def media_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: its text as stored media, read back (see round_trip); null counts as empty."""
    names = [id_col] + [x.split()[0] for x in ROUND_TRIP.split(", ")]
    found = automaton()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(batch.column(1))
        rows = [round_trip(texts.text(i), found) for i in range(len(texts))]
        return batch_of(names, [batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))])

    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {dict(df.dtypes)[id_col]}, {ROUND_TRIP}")
