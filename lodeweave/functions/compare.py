"""How far apart two names are: cores and decorations, words, scripts, versions and numbers."""

from __future__ import annotations

import unicodedata
from functools import cached_property

import regex

# What a difference costs beside the share of edits.
DECORATION, ROMANIZED, SOFT = 0.2, 0.05, 0.05
# Words that make a name another recording, and words of another master or cut; folded.
VERSIONS = {
    "live version": ("live", "en vivo", "ao vivo", "en directo", "en direct", "ライブ", "现场", "라이브"),
    "instrumental": ("instrumental", "inst", "instru", "off vocal", "オフボーカル", "伴奏", "인스트"),
    "karaoke": ("karaoke", "カラオケ", "卡拉ok"),
    "acoustic version": ("acoustic", "acustico", "akustik", "アコースティック", "어쿠스틱"),
    "remix": ("remix", "リミックス", "리믹스"),
    "cover": ("cover", "カバー", "翻唱"),
    "demo": ("demo", "デモ"),
}
SOFT_VERSIONS = ("remastered", "remaster", "リマスター", "edit", "mix", "mono", "version", "ver")
# Words that number a name as one of a series; distances (thousandths) of names alike and apart; words a cut name keeps.
SERIES = {"volume", "vol", "part", "pt", "disc", "cd", "book", "act"}
ALIKE, APART, CUT_WORDS = 200, 500, 3
_BRACKETED = regex.compile(r"[(\[{【「『〈《〔〖]([^)\]}】」』〉》〕〗]*)[)\]}】」』〉》〕〗]")
_SUFFIX = regex.compile(r"\s[-–—‐‒―−]\s(.+)$")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_SCRIPTS = {s: regex.compile(rf"\p{{{s}}}") for s in ("Latin", "Cyrillic", "Greek", "Armenian", "Georgian", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Thai", "Devanagari")}
_ROMANIZED = {"Cyrillic", "Greek", "Armenian", "Georgian"}
_TENS, _UNITS = ("", "x", "xx"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")
ROMAN = {_TENS[n // 10] + _UNITS[n % 10]: n for n in range(1, 21)}


def fold(text: str) -> str:
    """Small letters without accents, width and form differences; kana keep their marks."""
    t = unicodedata.normalize("NFKD", text.casefold())
    return unicodedata.normalize("NFC", "".join(c for c in t if not unicodedata.combining(c) or c in "゙゚"))


def words(folded: str) -> list[str]:
    """Runs of letters and digits, apostrophes within left out."""
    return regex.findall(r"[\p{L}\p{N}]+", folded.replace("'", "").replace("’", ""))


def units(text: str) -> list[str]:
    """What an edit counts: characters as a reader sees them, a Hangul syllable as its letters."""
    out: list[str] = []
    for g in regex.findall(r"\X", text):
        out += unicodedata.normalize("NFD", g) if len(g) == 1 and "가" <= g <= "힣" else [g]
    return out


def edits(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edit_share(a: str, b: str) -> float:
    u, v = units(a), units(b)
    return edits(u, v) / max(len(u), len(v)) if u or v else 0.0


def monge_elkan(a: list[str], b: list[str]) -> float:
    """How alike the words of a are to those of b: each in turn takes its closest free word (the first of equals); over the longer list, 0 where one is empty."""
    free, total = list(b), 0.0
    if not a or not b:
        return 0.0
    for w in a:
        if free:
            alike = [1 - edit_share(w, v) for v in free]
            best = max(range(len(free)), key=lambda n: (alike[n], -n))
            total += alike[best]
            free.pop(best)
    return total / max(len(a), len(b))


def script_of(ch: str) -> str | None:
    """Script of a letter; Chinese and Japanese mix Han and kana, so those are one."""
    found = next((s for s, p in _SCRIPTS.items() if p.match(ch)), None)
    return "Han" if found in ("Hiragana", "Katakana") else found


def main_script(text: str) -> str | None:
    """The script most letters are of; the first seen of equals; none without letters."""
    counts: dict[str, int] = {}
    for c in text:
        if s := script_of(c):
            counts[s] = counts.get(s, 0) + 1
    return max(counts, key=counts.get) if counts else None


def romanized(text: str) -> str:
    """Letters of alphabets by the Latin spelling of their Unicode names (ZHE as zh, KA as k), other characters as they are."""
    out = []
    for c in text:
        s = script_of(c)
        if s not in _ROMANIZED:
            out.append(c)
            continue
        name = unicodedata.name(unicodedata.normalize("NFD", c)[0], "").rpartition("LETTER ")[2].split(" WITH ")[0].lower()
        if "sign" in name:
            continue
        if s == "Greek":
            sound = {"theta": "th", "phi": "ph", "chi": "ch", "psi": "ps", "omega": "o", "eta": "i", "upsilon": "y"}.get(name, name.split(" ")[-1][:1])
        else:
            sound = {"short i": "i", "io": "yo", "yeru": "y", "tse": "ts", "el": "l", "em": "m", "en": "n", "er": "r", "es": "s", "ef": "f", "ha": "kh", "e": "e", "ie": "e"}.get(name, name)
            if sound == name and len(name) > 1 and name[0] not in "aeiouy":
                sound = name.rstrip("aeiou") or name
        out.append(sound)
    return "".join(out)


def numbers(text: str, ws: list[str]) -> set[str]:
    """Digit runs without leading zeros, and Roman numerals to XX; I and V only after a word of a series."""
    out = {n.lstrip("0") for n in regex.findall(r"[0-9]+", text)}
    for i, w in enumerate(ws):
        if w in ROMAN and (w not in ("i", "v") or i and ws[i - 1] in SERIES):
            out.add(str(ROMAN[w]))
    return out


def _holds(ws: list[str], entry: str) -> bool:
    wanted = entry.split(" ")
    if _UNSPACED.search(entry):
        return any(entry in w for w in ws)
    return any(ws[i : i + len(wanted)] == wanted for i in range(len(ws) - len(wanted) + 1))


class Name:
    """A name taken apart: its core, and decorations in brackets or after a spaced dash."""

    def __init__(self, text: str) -> None:
        self.text = unicodedata.normalize("NFKC", text)
        rest, parts = self.text, []
        if m := _SUFFIX.search(rest):
            rest, parts = rest[: m.start()], [m[1]]
        parts = [m[1] for m in _BRACKETED.finditer(rest)] + [x for p in parts for x in ([m[1] for m in _BRACKETED.finditer(p)] or [p])]
        core = _BRACKETED.sub(" ", rest).strip()
        if not words(fold(core)):
            core, parts = self.text, []
        self.core = " ".join(fold(core).split())
        self.decorations = [" ".join(fold(p).split()) for p in parts if words(fold(p))]

    @cached_property
    def words(self) -> list[str]:
        return words(self.core)

    @cached_property
    def versions(self) -> tuple[set[str], bool]:
        held = [words(d) for d in self.decorations]
        return {k for k, es in VERSIONS.items() if any(_holds(w, e) for w in held for e in es)}, any(_holds(w, e) for w in held for e in SOFT_VERSIONS)

    @cached_property
    def numbers(self) -> set[str]:
        every = [e for es in VERSIONS.values() for e in es] + list(SOFT_VERSIONS)
        out = numbers(self.core, self.words)
        for d in self.decorations:
            if not any(_holds(words(d), e) for e in every):
                out |= numbers(d, words(d))
        return out

    @cached_property
    def series(self) -> set[str]:
        return {n for d in self.decorations if SERIES & set(words(d)) for n in numbers(d, words(d))}

    @cached_property
    def script(self) -> str | None:
        return main_script(self.core)


def compared(a: Name, b: Name) -> tuple[float, set[str]] | None:
    """Distance from 0 to 1 and what makes the two other recordings; none where a side has no letter, or no rule bridges their scripts.

    The less of the share of edits, decorations weighing a fifth, and of the words' unlikeness both ways; a romanization and a
    soft version word on one side cost a twentieth each. Kanji alone against kana alone can't be told.
    """
    if not a.words or not b.words:
        return None
    kana = [bool(regex.search(r"[\p{Hiragana}\p{Katakana}]", x.core)) for x in (a, b)]
    han = [bool(regex.search(r"\p{Han}", x.core)) for x in (a, b)]
    if any(han[i] and not kana[i] and kana[1 - i] and not han[1 - i] for i in (0, 1)):
        return None
    cost = 0.0
    if a.script and b.script and a.script != b.script:
        if "Latin" not in (a.script, b.script) or not {a.script, b.script} & _ROMANIZED:
            return None
        a, b = (Name(romanized(x.text)) if x.script != "Latin" else x for x in (a, b))
        cost = ROMANIZED
    core, dec = [units(x.core) for x in (a, b)], [units(" ".join(x.decorations)) for x in (a, b)]
    weight = max(map(len, core)) + DECORATION * max(map(len, dec))
    by_edits = (edits(*core) + DECORATION * edits(*dec)) / weight
    by_words = 1 - (monge_elkan(a.words, b.words) + monge_elkan(b.words, a.words)) / 2
    cost += SOFT * (a.versions[1] != b.versions[1])
    conflicts = a.versions[0] ^ b.versions[0] | ({"another number"} if a.numbers != b.numbers else set())
    return min(1.0, min(by_edits, by_words) + cost), conflicts


def agree(a: Name, b: Name) -> bool | None:
    """Whether two names are one thing's: alike within ALIKE or one cut short after CUT_WORDS; apart past APART, by a number or as another of a series; else unknown."""
    if a.series and b.series and a.series != b.series:
        return False
    short, long = sorted((a, b), key=lambda x: len(x.words))
    tail = long.words[len(short.words) :]
    numbering = any(any(c.isnumeric() for c in w) or w in SERIES or w in ROMAN for w in tail)
    if len(short.words) >= CUT_WORDS and len(long.core.split()) >= CUT_WORDS and long.words[: len(short.words)] == short.words and not numbering:
        return True
    found = compared(Name(a.core), Name(b.core))
    if found is None:
        return None
    thousandths = round(found[0] * 1000)
    return False if found[1] or thousandths > APART else True if thousandths <= ALIKE else None
