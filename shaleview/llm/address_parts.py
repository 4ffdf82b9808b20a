"""Parts of a postal address as typed: number, unit, street, kind of street, direction, town, state and postal code."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from ..functions.normalise import STATES as US_STATES
from .names import near

# Abbreviations of street kinds, directions, units and countries.
KINDS = {k: v for v, ks in {
    "court": "ct court crt", "road": "rd road", "lane": "ln lane la", "place": "pl place plc", "drive": "dr drive drv", "avenue": "ave avenue av aven",
    "parkway": "pkwy parkway pky parkwy", "terrace": "ter terrace terr", "street": "st street str strasse straße", "boulevard": "blvd boulevard boul bvd",
    "circle": "cir circle", "way": "way wy", "highway": "hwy highway", "square": "sq square", "trail": "trl trail", "crescent": "cres crescent", "close": "close cl",
}.items() for k in ks.split()}
DIRECTIONS = {k: v for v, ks in {"n": "n no north nord", "s": "s so south", "e": "e ea east ost", "w": "w we west", "ne": "ne northeast", "nw": "nw northwest", "se": "se southeast", "sw": "sw southwest"}.items() for k in ks.split()}
UNITS = {"apt", "apartment", "unit", "ste", "suite", "flat", "whg", "wohnung", "rm", "room", "appt", "app"}
STATES = {k: v.lower() for k, v in US_STATES.items()}
COUNTRIES = {k: v for v, ks in {
    "us": ["us", "usa", "united states", "united states of america", "u s a", "u s", "america"], "gb": ["gb", "uk", "united kingdom", "england", "great britain", "u k", "scotland", "wales"],
    "de": ["de", "d", "germany", "deutschland"],
}.items() for k in ks}
UK_CODE = re.compile(r"\b([a-z]{1,2}\d[a-z\d]?) ?(\d[a-z]{2})\b")
NUMBER = re.compile(r"\d+[a-z]?$")


@lru_cache(maxsize=1 << 16)
def plain(s: str) -> str:
    s = s.replace("ß", "ss").replace("ẞ", "ss").lower()
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s,#/-]|_", " ", s)).strip(" ,")


def postal_code(s: str) -> str:
    """Digits with lost leading zeros restored and the add-on dropped; UK codes without the space."""
    s = re.sub(r"[^\w-]", "", s.lower())
    s = s.split("-")[0]
    if s.isdigit() and 3 <= len(s) <= 5:
        return s.zfill(5)
    return s[:5] if s.isdigit() and len(s) == 9 else s


def _street(words: list[str], known: bool = False) -> dict[str, str]:
    """Parts of a street segment: number, unit, name, kind, direction. known: the house number came before."""
    out = {"number": "", "unit": "", "name": "", "kind": "", "direction": ""}
    rest: list[str] = []
    i = 0
    while i < len(words):
        w = words[i]
        after = words[i + 1] if i + 1 < len(words) else ""
        marker = w in UNITS or w == "#" or w in ("no", "nr", "num", "number", "we") and NUMBER.match(after) and bool(out["number"] or known)
        if w in ("nr", "no") and NUMBER.match(after) and not marker:
            i += 1
            continue
        if marker:
            j = i + 1
            while j < len(words) and words[j] in ("no", "nr", "#", "number"):
                j += 1
            if j < len(words) and re.match(r"(\d+[a-z]?|[a-z]\d*)$", words[j]):
                out["unit"] = words[j]
                if words[j].isdigit() and j + 1 < len(words) and re.match(r"[a-z]$", words[j + 1]) and words[j + 1] not in DIRECTIONS:
                    out["unit"] += words[j + 1]
                    j += 1
                i = j + 1
                continue
            i = j
            continue
        if NUMBER.match(w) and not out["number"]:
            out["number"] = w
            i += 1
            continue
        rest.append(w)
        i += 1
    if rest and (len(rest) > 1 or out["number"]):
        last = rest[-1]
        if last in DIRECTIONS and len(rest) > 1:
            out["direction"] = DIRECTIONS[last]
            rest = rest[:-1]
        elif rest[0] in DIRECTIONS and len(rest) > 1 and not (len(rest) == 2 and rest[1] in KINDS):
            out["direction"] = DIRECTIONS[rest[0]]
            rest = rest[1:]
        if len(rest) > 1 and rest[-1] in KINDS:
            out["kind"] = KINDS[rest[-1]]
            rest = rest[:-1]
        elif len(rest) > 1 and len(rest[-1]) > 4 and (k := [v for x, v in KINDS.items() if len(x) > 4 and near(rest[-1], x)]):
            out["kind"] = k[0]
            rest = rest[:-1]
        elif len(rest) > 1 and rest[-2] in KINDS and len(rest) > 2:
            out["kind"] = KINDS[rest[-2]]
            rest = rest[:-2] + rest[-1:]
    name = "".join(rest)
    m = re.match(r"(.{3,}?)-?(strasse|strase|srtasse|starsse|str)$", name)
    if m and not out["kind"]:
        name, out["kind"] = m[1], "street"
    out["name"] = name.replace("-", "")
    return out


def parse(street: str | None, city: str | None, state: str | None, code: str | None, country: str | None) -> dict[str, str] | None:
    """All parts as plain strings, "" where missing; None if there is no street with a name."""
    segments = [x for x in (y.strip() for y in plain(street or "").replace("#", " # ").split(",")) if x]
    out = {"number": "", "unit": "", "name": "", "kind": "", "direction": "", "town": "", "state": "", "code": postal_code(plain(code or "")), "country": COUNTRIES.get(plain(country or ""), "")}
    local = [x.strip() for x in plain(city or "").split(",") if x.strip()]
    for s in segments:
        m = UK_CODE.search(s)
        if m and out["name"]:
            out["code"] = out["code"] or m[1] + m[2]
            s = UK_CODE.sub(" ", s).strip()
            if not s:
                continue
        words = s.split()
        if out["name"] and not (words[0] in UNITS or words[0] in ("#", "no", "nr", "we") and len(words) > 1 or all(w in DIRECTIONS or w in KINDS for w in words)):
            if NUMBER.match(s) and not out["number"] and len(s) < 5:
                out["number"] = s
            else:
                local.append(s)
            continue
        got = _street(words, bool(out["number"]))
        for k, v in got.items():
            if v and k == "name" and out["name"]:
                continue
            if v and not out[k]:
                out[k] = v
    for s in local:
        s = UK_CODE.sub(lambda m: out.update(code=out["code"] or m[1] + m[2]) or " ", s)
        words = []
        for w in s.split():
            if re.match(r"\d{4,5}(-\d{4})?$", w):
                out["code"] = out["code"] or postal_code(w)
            else:
                words.append(w)
        s = " ".join(words)
        if s in STATES or len(s) == 2 and s in STATES.values():
            out["state"] = out["state"] or STATES.get(s, s)
            continue
        if len(words) > 1 and words[-1] in STATES.values():
            out["state"], s = out["state"] or words[-1], " ".join(words[:-1])
        if s in COUNTRIES:
            continue
        if s and not out["town"]:
            out["town"] = s.replace(" ", "").replace("-", "")
    st = plain(state or "")
    out["state"] = STATES.get(st, st) or out["state"]
    out["unit"] = out["unit"].lstrip("0") if out["unit"] != "0" else "0"
    out["number"] = out["number"].lstrip("0")
    return out if out["name"] else None
