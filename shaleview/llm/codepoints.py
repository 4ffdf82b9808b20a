"""Text as numpy code-point arrays: lookup-table gathers over whole Arrow batches.

A batch of strings is one UTF-8 buffer in Arrow. It is decoded once to 32-bit code points; row limits are
found by counting the bytes that begin a character. Every later step is a gather or a segmented reduction
over the batch, never a string call for one row.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

FULLWIDTH, COMBINING, ZERO_WIDTH, NBSP = 1, 2, 4, 8
LATIN, CYRILLIC, GREEK, OTHER_LETTER = 16, 32, 64, 128
LETTER = LATIN | CYRILLIC | GREEK | OTHER_LETTER
N = 0x110000

# Letters of other scripts that are drawn like a Latin letter.
GREEK_LIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "γ": "y", "χ": "x", "ϲ": "c", "ϳ": "j",
}
CYRILLIC_LIKE = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T",
    "Х": "X", "У": "Y", "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "х": "x", "у": "y",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
}


def in_ranges(table: np.ndarray, flag: int, *ranges: tuple[int, int]) -> None:
    for lo, hi in ranges:
        table[lo : hi + 1] |= flag


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    t = np.zeros(N, np.uint8)
    in_ranges(t, FULLWIDTH, (0xFF01, 0xFF5E), (0x3000, 0x3000))
    in_ranges(t, COMBINING, (0x300, 0x34E), (0x350, 0x36F), (0x483, 0x487), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20F0), (0xFE20, 0xFE2F))
    in_ranges(t, ZERO_WIDTH, (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E),
              (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0001, 0xE007F), (0xE0100, 0xE01EF))
    in_ranges(t, NBSP, (0xA0, 0xA0), (0x2007, 0x2007), (0x202F, 0x202F))
    for i in [*range(0x41, 0x250), *range(0x370, 0x530), *range(0x530, 0x600), *range(0x1E00, 0x2000), *range(0xFF21, 0xFF5B)]:
        if unicodedata.category(chr(i))[0] == "L":
            name = unicodedata.name(chr(i), "")
            kind = LATIN if "LATIN" in name or i in (0xAA, 0xBA) else CYRILLIC if "CYRILLIC" in name else GREEK if "GREEK" in name else 0 if i < 0x100 else OTHER_LETTER
            t[i] |= kind
    return t


@lru_cache(maxsize=1)
def to_latin() -> np.ndarray:
    """Look-alike letters of Greek and Cyrillic to Latin; 0 where there is none."""
    t = np.zeros(N, np.uint32)
    for x, y in (GREEK_LIKE | CYRILLIC_LIKE).items():
        t[ord(x)] = ord(y)
    return t


@lru_cache(maxsize=1)
def to_cyrillic() -> np.ndarray:
    """Look-alike letters of Latin and Greek to Cyrillic; 0 where there is none."""
    t = np.zeros(N, np.uint32)
    back = {y: x for x, y in reversed(CYRILLIC_LIKE.items())}
    for latin, cyr in back.items():
        t[ord(latin)] = ord(cyr)
    for greek, latin in GREEK_LIKE.items():
        if latin in back:
            t[ord(greek)] = ord(back[latin])
    return t


@lru_cache(maxsize=1)
def expansion() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, length, pool): compatibility forms of each code point; length 1 at offset -1 is the point itself."""
    off, length, pool = np.full(N, -1, np.int32), np.ones(N, np.uint8), []
    for i in [*range(0xA0, 0x250), *range(0x2000, 0x2070), *range(0x2100, 0x2140), 0x3000, *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        c = chr(i)
        folded = unicodedata.normalize("NFKC", c)
        if i in (0xA0, 0x2007, 0x202F, 0x3000) or folded in (" ", "") and unicodedata.category(c) == "Zs":
            folded = " "
        elif i < 0x2000 and not 0xFB00 <= i:
            continue  # marks of quantity and accented letters stay as they are
        if folded != c:
            off[i], length[i] = len(pool), len(folded)
            pool += map(ord, folded)
    length[classes() & ZERO_WIDTH > 0] = 0
    return off, length, np.array(pool, np.uint32)


@lru_cache(maxsize=1)
def compositions() -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys base * 2**21 + mark, and the composed character of each."""
    found = {}
    for i in [*range(0xC0, 0x600), *range(0x1E00, 0x2000)]:
        d = unicodedata.decomposition(chr(i))
        if d and d[0] != "<" and len(parts := d.split()) == 2 and unicodedata.normalize("NFC", "".join(chr(int(p, 16)) for p in parts)) == chr(i):
            found[int(parts[0], 16) << 21 | int(parts[1], 16)] = i
    keys = np.array(sorted(found), np.uint64)
    return keys, np.array([found[int(k)] for k in keys], np.uint32)


def explode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the whole array, start of each row and the end); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = memoryview(buffers[2])[int(ends[0]) : int(ends[-1])] if buffers[2] is not None else b""
    data = np.frombuffer(raw, np.uint8)
    starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))[ends - ends[0]]
    return np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32), starts


def implode(points: np.ndarray, starts: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The string array of code points with row limits; the inverse of explode."""
    size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    ends = np.concatenate(([0], np.cumsum(size)))[starts].astype(np.int64)
    raw = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    out = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw))
    return out if valid is None else pa.compute.if_else(pa.array(valid), out, pa.scalar(None, pa.large_string()))


def words_mixed(points: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position: 0 or the script (LATIN or CYRILLIC) that a letter of another script stands in.

    A word is a run of letters; marks and invisible characters inside it are no break. The word's script is the
    one of most of its letters, Latin on a tie, and only Latin and Cyrillic words have strangers. A run of
    one script has none.
    """
    inside = (kind & (LETTER | COMBINING | ZERO_WIDTH)) > 0
    edge = np.zeros(len(points) + 1, bool)
    edge[starts] = True
    begin = inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1])))
    out = np.zeros(len(points), np.uint8)
    if not begin.any():
        return out, inside
    foreign = (kind & (CYRILLIC | GREEK | OTHER_LETTER)) > 0
    if not foreign.any():
        return out, inside
    word = np.cumsum(begin) - 1
    at = np.flatnonzero(inside)
    w = word[at]
    n = int(begin.sum())
    count = {s: np.bincount(w, (kind[at] & s) > 0, n) for s in (LATIN, CYRILLIC, GREEK, OTHER_LETTER)}
    other = count[GREEK] + count[OTHER_LETTER]
    latin = (count[LATIN] > 0) & (count[LATIN] >= count[CYRILLIC]) & (count[CYRILLIC] + other > 0)
    cyr = (count[CYRILLIC] > 0) & (count[CYRILLIC] > count[LATIN]) & (count[LATIN] + other > 0)
    script = np.where(latin, LATIN, np.where(cyr, CYRILLIC, 0)).astype(np.uint8)
    s = script[w]
    out[at] = np.where((s > 0) & ((kind[at] & LETTER) > 0) & ((kind[at] & s) == 0), s, 0)
    return out, inside


def kinds(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A bool matrix (row, kind) for fullwidth, combining, zero_width, nbsp, lookalike."""
    kind = classes()[points]
    mixed, _ = words_mixed(points, kind, starts)
    out = np.zeros((len(starts) - 1, 5), bool)
    for k, hit in enumerate([(kind & f) > 0 for f in (FULLWIDTH, COMBINING, ZERO_WIDTH, NBSP)] + [mixed > 0]):
        at = np.flatnonzero(hit)
        out[np.searchsorted(starts, at, "right") - 1, k] = True
    return out


def unify(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One consistent form: look-alikes in their word's script, widths and spaces plain, invisible characters gone, marks composed."""
    kind = classes()[points]
    mixed, _ = words_mixed(points, kind, starts)
    points = points.copy()
    for script, table in ((LATIN, to_latin()), (CYRILLIC, to_cyrillic())):
        at = np.flatnonzero(mixed == script)
        new = table[points[at]]
        points[at] = np.where(new > 0, new, points[at])
    off, length, pool = expansion()
    size = length[points].astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(size)))
    source = np.repeat(np.arange(len(points)), size)
    o = off[points[source]]
    wide = np.flatnonzero(o >= 0)
    out = points[source]
    out[wide] = pool[o[wide] + (wide - ends[source[wide]])]
    starts = ends[starts]
    keys, composed = compositions()
    while True:
        mark = (classes()[out] & COMBINING) > 0
        mark[starts[:-1][starts[:-1] < len(out)]] = False  # a mark that begins a row has no base
        at = np.flatnonzero(mark[1:] & ~mark[:-1]) + 1
        if not len(at):
            return out, starts
        key = out[at - 1].astype(np.uint64) << np.uint64(21) | out[at].astype(np.uint64)
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = keys[i] == key
        if not ok.any():
            return out, starts
        at, i = at[ok], i[ok]
        out[at - 1] = composed[i]
        keep = np.ones(len(out), bool)
        keep[at] = False
        starts = np.concatenate(([0], np.cumsum(keep)))[starts]
        out = out[keep]


DROPPED = 0xFFFFFFFF
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """Code point to its plain lower-case letter or digit; 0 is a separator, DROPPED vanishes."""
    t = np.zeros(N, np.uint32)
    t[0x30000:0x32000] = np.arange(0x30000, 0x32000)
    like = {ord(x): ord(y.lower()) for x, y in (GREEK_LIKE | CYRILLIC_LIKE).items()}
    for i in range(0x30000):
        if 0xAC00 <= i <= 0xD7A3 or 0x3400 <= i <= 0x9FFF or 0x20000 <= i:
            t[i] = i
            continue
        if 0xD800 <= i < 0xE000 or not (c := chr(i)).isalnum():
            continue
        base = unicodedata.normalize("NFKD", c)[0].lower()[0]
        t[i] = like.get(i) or like.get(ord(base)) or (ord(base) if base.isalnum() else i)
    t[(classes() & (COMBINING | ZERO_WIDTH)) > 0] = DROPPED
    return t


def _powers(base: np.uint64, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    if len(cache.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        cache[base] = np.cumprod(steps, dtype=np.uint64)
    return cache[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * BASE**position, from which the hash of any span follows."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(values.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(values)), dtype=np.uint64)))


def spans(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [begin, end)."""
    inverse = _powers(INVERSE, len(prefix))
    return mixed((prefix[end] - prefix[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def folded(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, where a word begins, where each row begins, where each letter was).

    Letters are plain and lower-case; a hyphen inside a word, also at a line end, joins its parts.
    """
    f = folding()[points]
    hyphen = (points == 0x2D) | (points == 0x2010) | (points == 0x2011)
    edge = np.zeros(len(points) + 1, bool)
    edge[starts] = True
    if hyphen.any():
        at = np.flatnonzero(hyphen)
        at = at[(at > 0) & (at + 1 < len(points))]
        at = at[~edge[at] & ~edge[at + 1]]
        letter = (f > 0) & (f != DROPPED) & ~((points >= 0x30) & (points <= 0x39))
        at = at[letter[at - 1]]
        new_line = (points == 10) | (points == 13)
        f[at[letter[at + 1]]] = DROPPED
        brk = at[new_line[at + 1]]
        f[brk] = f[brk + 1] = DROPPED
    keep = f != DROPPED
    begins = np.concatenate(([0], np.cumsum(keep)))[starts]
    was = np.flatnonzero(keep)
    f = f[keep]
    edge = np.zeros(len(f) + 1, bool)
    edge[begins] = True
    letter = f > 0
    first = letter & (edge[:-1] | ~np.concatenate(([False], letter[:-1])))
    begins = np.concatenate(([0], np.cumsum(letter)))[begins]
    return f[letter], first[letter], begins, was[letter]


def word_hashes(letters: np.ndarray, first: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end)."""
    at = np.flatnonzero(first)
    end = np.concatenate((at[1:], [len(letters)])).astype(np.int64) if len(at) else at
    return spans(sums(letters), at, end), np.searchsorted(at, begins)
