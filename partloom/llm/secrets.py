"""Secret scans: patterns over whole texts and over every layer that can be unwrapped from them, to a fixpoint."""

from __future__ import annotations

import binascii
import bz2
import lzma
import re
import zlib
from collections import deque
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import small_batches, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|((?:\\u[0-9A-Fa-f]{4})+)|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
SHORTEST_RUN = 19  # base64 letters of the shortest secret, `token=` and eight characters
SHORTEST_TEXT = 14  # bytes of it
ENCODED = re.compile(r"(?:[A-Za-z0-9+/_-]{60,}\r?\n[ \t]*)+[A-Za-z0-9+/_-]+|[A-Za-z0-9+/_-]{19,}")  # lines of 60 and more may go on
PLAIN = re.compile(rb"[\t\n\r\x20-\x7e]{14,}")
MAGIC = re.compile("\x1f\x8b\x08|x[\x01^\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\\(\xb5/\xfd")  # gzip, zlib, bzip2, xz, zstandard; bytes as characters
BYTES = re.compile("[\x00-\xff]+")

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODE = np.zeros(256, bool)
CODE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
SIGNS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"akia", b"%", b"\\u", b"\\x", b"&#", "\x1f\x8b\x08".encode(), b"x\x01", b"x^", "x\x9c".encode(), "x\u00da".encode(), b"bzh", "\xfd7zxz".encode(), "(\xb5/\xfd".encode()]  # in lower case A-Z


def matches(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of the patterns, leftmost and not overlapping within a kind; a match that is too
    short is dropped but has taken its characters."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]


class Layer:
    """A text that was unwrapped from the document; `at` gives the document's characters that a part of it came from."""

    def __init__(self, text: str, at, path: str = ""):
        self.text, self.at, self.path = text, at, path

    def key(self):
        return blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), self.at(0, len(self.text))

    def child(self, text: str, local, name: str) -> Layer:
        return Layer(text, lambda s, e: self.at(*local(s, e)), f"{self.path}>{name}" if self.path else name)

    def rewritten(self, edits: list[tuple[int, int, list]], name: str) -> Layer:
        """With parts replaced: edits (start, end, characters as (text, start, end) each)."""
        texts, starts, ends, done = [], [], [], 0
        for start, end, chars in edits:
            texts += [self.text[done:start], *(c for c, _, _ in chars)]
            starts += [np.arange(done, start), np.array([s for _, s, _ in chars], np.int64)]
            ends += [np.arange(done, start) + 1, np.array([e for _, _, e in chars], np.int64)]
            done = end
        rest = np.arange(done, len(self.text))
        starts, ends = np.concatenate([*starts, rest]), np.concatenate([*ends, rest + 1])
        return self.child("".join([*texts, self.text[done:]]), lambda s, e: (int(starts[s]), int(ends[e - 1])), name)


def percent_layers(layer: Layer):
    """Percent codes as UTF-8, or as single bytes where they are none; all as bytes too, where those may be compressed."""
    for whole_bytes in (False, True):
        edits = []
        for m in PERCENT.finditer(layer.text):
            data, chars, at = bytes.fromhex(m[0].replace("%", "")), [], m.start()
            try:
                text = data.decode("latin-1" if whole_bytes else "utf-8")
            except UnicodeDecodeError:
                text = data.decode("latin-1")
            wide = len(text) < len(data)
            for c in text:
                n = 3 * (len(c.encode()) if wide else 1)
                chars.append((c, at, at + n))
                at += n
            edits.append((m.start(), m.end(), chars))
        if edits:
            out = layer.rewritten(edits, "url")
            if not whole_bytes or MAGIC.search(out.text):
                yield out


def escape_layers(layer: Layer):
    """Unicode escapes of source code and of markup; what is no character stays."""
    edits = []
    for m in ESCAPE.finditer(layer.text):
        if m[2]:
            units = b"".join(int(u, 16).to_bytes(2, "little") for u in m[2].split("\\u")[1:])
            at, chars = m.start(), []
            for c in units.decode("utf-16-le", "surrogatepass"):
                n = 12 if ord(c) > 0xFFFF else 6
                chars.append((layer.text[at : at + n] if 0xD800 <= ord(c) <= 0xDFFF else c, at, at + n))
                at += n
            chars = [x for c, s, e in chars for x in ([(c, s, e)] if len(c) == 1 else [(layer.text[i], i, i + 1) for i in range(s, e)])]
            edits.append((m.start(), m.end(), chars))
            continue
        code = int(m[6]) if m[6] else int(m[1] or m[3] or m[4] or m[5], 16)
        if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF:
            edits.append((m.start(), m.end(), [(chr(code), m.start(), m.end())]))
    if edits and (out := layer.rewritten(edits, "unicode")).text != layer.text:
        yield out


def base64_layers(layer: Layer):
    """What runs of base64 letters, of either alphabet, hold: at each of four alignments, as other letters may stand
    before the code. Text is kept whole if it is UTF-8, else in its plain parts; bytes only if they may be compressed."""
    for m in ENCODED.finditer(layer.text):
        run, places = m[0], None
        if "\n" in run:
            places = [i for i, c in enumerate(run) if c not in "\r\n \t"]
            run = "".join(run[i] for i in places)
        place = (lambda i, p=places, a=m.start(): a + (p[i] if p else i))
        run = run.replace("-", "+").replace("_", "/")
        for o in range(min(4, len(run) - SHORTEST_RUN + 1)):
            code = run[o:]
            code = code[: len(code) - (len(code) % 4 == 1)]
            data = binascii.a2b_base64(code + "=" * (-len(code) % 4))
            letters = lambda s, e, o=o, place=place: (place(o + s // 3 * 4 + s % 3), place(o + (e - 1) // 3 * 4 + (e - 1) % 3 + 1) + 1)
            try:
                text = data.decode()
                if text.isascii():
                    yield layer.child(text, letters, "base64")
                else:
                    yield layer.child(text, lambda s, e, t=text, f=letters: f(len(t[:s].encode()), len(t[:e].encode())), "base64")
            except UnicodeDecodeError:
                for p in PLAIN.finditer(data):
                    yield layer.child(p[0].decode(), lambda s, e, a=p.start(), f=letters: f(a + s, a + e), "base64")
                text = data.decode("latin-1")
                if MAGIC.search(text):
                    yield layer.child(text, letters, "base64")


def inflated(data: memoryview, most: int):
    """(content, bytes taken, whether it is whole) of compressed data at the beginning of `data`; None if there is none."""
    try:
        if data[:1] in (b"\x1f", b"x"):
            d = zlib.decompressobj(wbits=47)
            out = d.decompress(data, most + 1)
        elif data[:3] == b"BZh":
            d = bz2.BZ2Decompressor()
            out = d.decompress(data, most + 1)
        elif data[:1] == b"\xfd":
            d = lzma.LZMADecompressor(memlimit=1 << 28)
            out = d.decompress(data, most + 1)
        else:
            read = zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(bytes(data), read_across_frames=False)
            out = read.read(most + 1)
            return (out[:most], len(data), len(out) <= most) if out else None
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        return None
    return (out[:most], len(data) - len(d.unused_data), len(out) <= most) if out else None


def compressed_layers(layer: Layer, left: list[int], unread: list[int]):
    """What compressed bytes hold. `left`: bytes that the document's layers may still take; what has more is counted in
    `unread`, and its part within the bound is a layer."""
    for run in BYTES.finditer(layer.text):
        data = None
        for m in MAGIC.finditer(layer.text, run.start(), run.end()):
            data = data or memoryview(run[0].encode("latin-1"))
            got = inflated(data[m.start() - run.start() :], left[0])
            if got:
                content, taken, whole = got
                left[0] -= len(content)
                unread[0] += not whole
                try:
                    text = content.decode()
                except UnicodeDecodeError:
                    text = content.decode("latin-1")
                yield layer.child(text, lambda s, e, a=m.start(), n=taken: (a, a + n), "compressed")


def scan(text: str, most_bytes: int = 1 << 26):
    """(matches in the text itself, matches in layers as (start, end, kind, path) without those of the text, sorted,
    number of compressed layers that were not read to their end).

    A worklist: each layer is searched and unwrapped in every way, and what comes out goes on the list, until nothing
    new comes. A layer that was seen before at the same place (a cycle, or two ways to one layer) is not taken again.
    """
    base, added, unread, left = matches(text), {}, [0], [most_bytes]
    own = set(base)
    root = Layer(text, lambda s, e: (s, e))
    todo, seen = deque([root]), {root.key()} if text else set()
    while todo:
        layer = todo.popleft()
        if layer is not root:
            for s, e, kind in matches(layer.text):
                place = (*layer.at(s, e), kind)
                if place not in own:
                    added.setdefault(place, layer.path)
        for ways in (percent_layers(layer), escape_layers(layer), base64_layers(layer), compressed_layers(layer, left, unread)):
            for child in ways:
                if len(child.text) >= SHORTEST_TEXT and (key := child.key()) not in seen:
                    seen.add(key)
                    todo.append(child)
    order = lambda x: (x[0], x[2], x[1])
    return sorted(base, key=order), sorted(((*p, path) for p, path in added.items()), key=order), unread[0]


def worth_reading(texts: pa.Array) -> np.ndarray:
    """Which texts hold anything that a pattern or a layer can begin with: one look at the batch's bytes."""
    raw = texts.cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    out = np.zeros(len(raw), bool)
    if raw.buffers()[2] is None or bounds[-1] == bounds[0]:
        return out
    data = np.frombuffer(raw.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    text_of = lambda at: np.searchsorted(bounds, at, side="right") - 1
    others = np.concatenate([[-1], np.flatnonzero(~CODE[data]), [len(data)]])
    for i in np.flatnonzero(np.diff(others) > SHORTEST_RUN):
        out[text_of(others[i] + 1) : text_of(others[i + 1] - 1) + 1] = True
    lower = LOWER[data].tobytes()
    for sign in SIGNS:
        at = lower.find(sign)
        while at >= 0:
            out[text_of(at)] = True
            at = lower.find(sign, int(bounds[text_of(at) + 1]))
    return out


SPAN = "array<struct<kind: string, start: int, end: int, layers: string>>"


def _scan_batches(batches, most_bytes: int):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layers", pa.string())]))
    for b in batches:
        texts = b.column("text")
        look, base, added, unread = worth_reading(texts), [], [], []
        for i in range(b.num_rows):
            own, more, rest = scan(texts[i].as_py(), most_bytes) if look[i] else ([], [], 0)
            base.append([{"kind": KINDS[k], "start": s, "end": e, "layers": ""} for s, e, k in own])
            added.append([{"kind": KINDS[k], "start": s, "end": e, "layers": path} for s, e, k, path in more])
            unread.append(rest)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(base, kind), pa.array(added, kind), pa.array(unread, pa.int32())], names=["id", "base", "added", "unread"])


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 1 << 26) -> DataFrame:
    """Secrets in every text: `id_col, base, added, unread`, one row for a row.

    `base`: what the patterns find in the text; `added`: what they find in its layers only. Both are arrays of `kind,
    start, end` (code points of the text, end exclusive) and `layers`, the way to it (`base64>compressed>url`), ordered
    by start, kind as in KINDS, end. Layers are percent codes, Unicode escapes (of code and of markup), base64 of 19 and
    more letters of either alphabet, glued to other letters or in lines of 60 and more, and gzip, zlib, bzip2, xz and
    zstandard data within those; each is unwrapped again until nothing new comes. A span in a layer is the characters
    that it was written with; in compressed data, all of these. The same span twice is one.

    `unread` counts compressed layers that were not read to their end, because the document's layers would take more
    than `most_bytes` in memory (data made to swell): they are reported, not passed over in silence.

    Null and empty texts have no secrets; ids may be null or repeat, every row is scanned by itself in its task and
    none is shuffled; other columns are not read. A batch whose texts hold no sign of any pattern is not searched.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_scan_batches, most_bytes=most_bytes), f"id {id_type}, base {SPAN}, added {SPAN}, unread int").withColumnRenamed("id", id_col)


def op13_secrets(spark, sf_dir) -> DataFrame:
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("nth"), s["end"].alias("end"), s["kind"].alias("kind"))
    every = F.array_sort(F.transform(F.concat("base", "added"), place))
    found = scan_secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long) as n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"), F.col("unread").cast("long").alias("n_unread"))
