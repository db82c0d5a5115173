"""Problem 10: shape figures of each text, and whether it is prose, a list, a table or junk.

Method: huge documents are split into chunks; each chunk gives associative partial counts, with the state at its
borders (the unfinished first and last line) kept apart; partial counts are merged in a tree; ratios and rule
outcomes are derived from the totals. The figures do not depend on where the chunks are cut.

A line may be as long as a text. It is counted in segments, whose ends depend only on the characters around them (see
`cuts`), so an unfinished line is held as counts of its finished segments and a bounded rest at either end. What is
counted is counted by whole arrays over many segments at once; Python looks at single words and lines only where a
pattern needs it.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.language import SETS
from strandline.session import durable

#: Characters of a chunk, and how many neighbouring states are merged at once.
CHUNK, FAN_IN = 65_536, 32
#: Least hashes kept to count different words, lines and runs: exact below, within some 3 % beyond, for any number.
LEAST = 1024
#: Words and lines of the windows whose mean share of different ones tells repetition, and words of a run. A window's share
#: does not fall with the length of the text; blocks too long for a window repeat long runs, which other texts do not.
WINDOW, WINDOW_LINES, RUN = 1000, 200, 24
#: Every REACH neighbouring places of a line hold an end of a segment; whether a place is one depends on CONTEXT characters before it.
REACH, CONTEXT = 4096, 8

COMMON = frozenset().union(*SETS.values())
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_LINE_END = re.compile(r"\r\n|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]")
_B = r"[^\S\n]"
_MARK = re.compile(rf"{_B}*(?:[-*•‣◦▪–—☐☑☒✓✔]{_B}+|\[[ xX]?\]{_B}+|\(?\d{{1,4}}[.)]{_B}+|\(?[a-zA-Z][.)]{_B}+)")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,300}>|&#?\w{1,8};")
_HEX = re.compile(r"[0-9a-fA-F]{2}|[0-9a-fA-F]{6,}")
_KEYED = re.compile(r"(?:^|[;,|&]\s*|\s{2,}|\t)\s*[\w.-]{1,30}(?:\s[\w.-]{1,20})?\s*[=:]\s?[^;=]*")
_SPEAKER = re.compile(rf"{_B}*(?:\[?\d{{1,4}}[/.-]\d{{1,2}}[/.-]\d{{1,4}}[^A-Za-zÀ-ÿ\n]{{0,20}}(?:[ap]\.?\s?m\.?)?[\]\s–-]*)?[^\W\d_][^\W\d_' .-]{{0,30}}(?: [^\W\d_]{{1,20}}){{0,2}}: \S")
_INNER = re.compile(rf"[.!?…]+[\"'»”)\]]*{_B}+(?=[\"'«“¿¡(]*[^\W\d_])")
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
_VOWELS = frozenset("aeiouáéíóúàèùâêîôûäöüy")

#: What a segment adds to its line, and what a line adds to its text.
ADDED = ["visible", "words", "wordlen", "long_words", "common", "letters", "digits", "vowels", "garbled", "inner", "tags", "hexes", "keyed", "commas", "tabs", "pipes", "semis", "gaps"]
AT = {c: i for i, c in enumerate(ADDED)}
DELIMITERS = ["commas", "tabs", "pipes", "semis", "gaps"]
COUNTS = [*ADDED, "lines", "ended", "marked", "entry_words", "entries", "keyed_lines", "speakers", "short_cells", *[f"{d}_lines" for d in DELIMITERS], *[f"{d}2" for d in DELIMITERS]]


_NONE = np.empty(0, np.uint64)


@dataclass
class Sequence:
    """Hashed items in order: their number, the sum of min(window, places since the same item), the items at both ends, the least hashes."""

    n: int = 0
    gaps: int = 0
    first: np.ndarray = field(default_factory=_NONE.copy)
    last: np.ndarray = field(default_factory=_NONE.copy)
    least: np.ndarray = field(default_factory=_NONE.copy)


def sequence(h: np.ndarray, window: int) -> Sequence:
    """The sequence of items given by their hashes, in order."""
    n = len(h)
    if not n:
        return Sequence()
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    gaps = np.full(n, window)
    gaps[1:][same] = np.minimum(window, np.diff(order)[same])
    # The ends are copies, so that no state keeps or pickles more of the text.
    first = h[:window].copy()
    return Sequence(n, int(gaps.sum()), first, first if n <= window else h[-window:].copy(), _least(h))


def follow(a: Sequence, b: Sequence, window: int) -> Sequence:
    """The sequence of a and then b; associative."""
    if not a.n or not b.n:
        return a if a.n else b
    gaps, behind = a.gaps + b.gaps, len(a.last)
    before = {h: i - behind for i, h in enumerate(a.last.tolist())}
    new = set()
    for i, h in enumerate(b.first.tolist()):
        if h not in new:
            new.add(h)
            gaps += min(0, i - before.get(h, i - window) - window)
    first = a.first if len(a.first) == window else np.concatenate([a.first, b.first])[:window]
    last = b.last if len(b.last) == window else np.concatenate([a.last, b.last])[-window:]
    return Sequence(a.n + b.n, gaps, first, last, _least(np.concatenate([a.least, b.least])))


def window_share(s: Sequence, window: int) -> float:
    """Mean share of different items over all windows; over the whole where it is shorter than a window."""
    if s.n <= window:
        return len(set(s.first.tolist())) / s.n if s.n else 0.0

    def beyond(items: list[int]) -> int:
        """Different items of the windows that reach beyond an end."""
        seen, total = set(), 0
        for h in items[: window - 1]:
            seen.add(h)
            total += len(seen)
        return total

    # An item is its window's first of a kind in as many windows as places lie since the same item, `window` at most.
    inside = s.gaps - beyond(s.first.tolist()) - beyond(s.last[::-1].tolist())
    return inside / ((s.n - window + 1) * window)


def _least(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes)[:LEAST]


def _distinct(least: np.ndarray, most: int) -> float:
    """Estimate of the number of different hashes of which these are the least ones."""
    return float(len(least)) if len(least) < LEAST else min(float(most), (LEAST - 1) * 2.0**64 / float(least[-1]))


def _runs(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of RUN = 16 + 8 words."""
    if len(h) < RUN:
        return _NONE
    base, by = 0x9E3779B97F4A7C15, {}
    run, n = h, 1
    while n < 16:
        run = run[:-n] * np.uint64(pow(base, n, 2**64)) + run[n:]
        n *= 2
        by[n] = run
    out = by[16][: len(h) - RUN + 1] * np.uint64(pow(base, 8, 2**64)) + by[8][16:]
    # The low bits of a product depend on low bits only; the order of the least hashes needs all.
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


# -- characters and words of many segments at once ---------------------------------------------------------------------

_ALPHA, _DIGIT, _SPACE, _VOWEL, _ODD, _WORDY = (1 << i for i in range(6))


def _class(code: int) -> int:
    c = chr(code)
    odd = code == 0xFFFD or code < 9 or 14 <= code < 32 or 128 <= code < 160
    return _ALPHA * c.isalpha() | _DIGIT * c.isdecimal() | _SPACE * c.isspace() | _VOWEL * (c.lower() in _VOWELS) | _ODD * odd | _WORDY * c.isalnum()


#: Classes of the characters of most scripts; rarer ones are looked up as they come.
_CLASSES = np.array([_class(c) for c in range(0x3000)], np.uint8)


def _classes(codes: np.ndarray) -> np.ndarray:
    rare = codes >= len(_CLASSES)
    out = _CLASSES[np.where(rare, 0, codes)]
    if rare.any():
        seen, where = np.unique(codes[rare], return_inverse=True)
        out[rare] = np.array([_class(int(c)) for c in seen], np.uint8)[where]
    return out


class _Known(dict):
    """Figures of words, each computed once: hash, whether it is a function word, length, characters of hexadecimal parts."""

    def __init__(self):
        self.rows: list[tuple[int, bool, int, int]] = []
        self.table = np.empty((0, 4), np.uint64)

    def __missing__(self, word: str) -> int:
        low = word.lower()
        hexes = sum(len(x) for x in re.split("['’-]", word) if _HEX.fullmatch(x) and any(c.isdigit() for c in x)) if any(c.isdigit() for c in word) else 0
        self.rows.append((xxhash.xxh64_intdigest(low), low in COMMON, len(word), hexes))
        self[word] = out = len(self.rows) - 1
        return out

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > 200_000:
            self.clear()
            self.__init__()
        index = np.fromiter((self[w] for w in words), np.int64, len(words))
        if len(self.rows) > len(self.table):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.uint64).reshape(-1, 4)])
        return self.table[index]


_KNOWN = _Known()


@dataclass
class Measured:
    """Per segment: sums (a row of ADDED), whether blank, marked, a speaker's, ended, sentence ends inside the mark, and the digest;
    per word, in order: its hash and segment."""

    sums: np.ndarray
    blank: np.ndarray
    marked: np.ndarray
    speaker: np.ndarray
    ended: np.ndarray
    mark_inner: np.ndarray
    digest: np.ndarray
    word: np.ndarray
    segment: np.ndarray


def _is_ended(text: str) -> bool:
    return text.rstrip().rstrip("\"'»”)]").endswith((".", "!", "?", "…"))


def measure(segments: list[str]) -> Measured:
    """Figures of segments without line ends."""
    n = len(segments)
    sizes = np.fromiter(map(len, segments), np.int64, n) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    text = "\n".join(segments) + "\n"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) if n else np.empty(0, np.uint32)
    if not n:
        codes, text = np.empty(0, np.uint32), ""
    kinds = _classes(codes)
    sums = np.zeros((n, len(ADDED)), np.int64)
    per = lambda mask: np.add.reduceat(mask.astype(np.int32), starts) if n else np.zeros(0, np.int64)
    at = lambda places: np.searchsorted(ends, places, side="right")
    tally = lambda places: np.bincount(at(np.asarray(places, np.int64)), minlength=n)[:n] if len(places) else np.zeros(n, np.int64)
    has = lambda bit: (kinds & bit) > 0
    sums[:, AT["visible"]] = per(~has(_SPACE))
    for name, bit in (("letters", _ALPHA), ("digits", _DIGIT), ("vowels", _VOWEL)):
        sums[:, AT[name]] = per(has(bit))
    for name, code in (("commas", 44), ("tabs", 9), ("pipes", 124), ("semis", 59)):
        sums[:, AT[name]] = per(codes == code)
    after = np.append(codes[1:], 0)
    pair = ((codes == 0xC2) | (codes == 0xC3)) & (after >= 0x80) & (after <= 0xBF) | (codes == 0xE2) & (after == 0x20AC)
    second = np.append(False, pair[:-1]) if n else pair
    sums[:, AT["garbled"]] = per(has(_ODD) & ~second) + 2 * per(pair)
    # Words start at a letter or digit that neither follows one nor is joined to one.
    wordy = has(_WORDY)
    before = np.append(False, wordy[:-1]) if n else wordy
    joint = (codes == 39) | (codes == 0x2019) | (codes == 45)
    joined = np.append(False, (joint & before)[:-1]) if n else wordy
    first = np.flatnonzero(wordy & ~before & ~joined)
    known = _KNOWN.of(_WORD.findall(text))
    if len(known) != len(first):
        first = np.fromiter((m.start() for m in _WORD.finditer(text)), np.int64)
    segment = at(first)
    weigh = lambda w: np.bincount(segment, weights=w, minlength=n)[:n].astype(np.int64) if len(w) else np.zeros(n, np.int64)
    sums[:, AT["words"]] = np.bincount(segment, minlength=n)[:n] if len(first) else 0
    sums[:, AT["wordlen"]], sums[:, AT["long_words"]] = weigh(known[:, 2]), weigh(known[:, 2] > 24)
    sums[:, AT["common"]], sums[:, AT["hexes"]] = weigh(known[:, 1]), weigh(known[:, 3])
    inner = np.fromiter((m.start() for m in _INNER.finditer(text)), np.int64)
    sums[:, AT["inner"]] = tally(inner)
    if "  " in text:
        sums[:, AT["gaps"]] = tally([m.start() for m in _GAP.finditer(text)])
    if "<" in text or "&" in text:
        tags = [m.span() for m in _TAG.finditer(text)]
        if tags:
            sums[:, AT["tags"]] = np.bincount(at([a for a, _ in tags]), weights=[b - a for a, b in tags], minlength=n)[:n].astype(np.int64)
    colon = codes == 58
    for k in np.flatnonzero(per(colon | (codes == 61)) >= 2).tolist():
        sums[k, AT["keyed"]] = len(_KEYED.findall(segments[k].strip()))
    blank = sums[:, AT["visible"]] == 0
    marked, speaker, ended, mark_inner = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64)
    spoken = per(colon & (after == 32)) > 0
    digest = np.zeros(n, np.uint64)
    places = starts.tolist()
    for k in np.flatnonzero(~blank).tolist():
        line = segments[k]
        m = _MARK.match(text, places[k])
        if m:
            marked[k] = True
            mark_inner[k] = np.count_nonzero((inner >= places[k]) & (inner < m.end()))
            ended[k] = _is_ended(line[m.end() - places[k] :])
        else:
            ended[k] = _is_ended(line)
        speaker[k] = spoken[k] and _SPEAKER.match(text, places[k]) is not None
        digest[k] = xxhash.xxh64_intdigest(line.strip())
    return Measured(sums, blank, marked, speaker, ended, mark_inner, digest, known[:, 0], segment)


def line_counts(sums: np.ndarray, marked: np.ndarray, speaker: np.ndarray, ended: np.ndarray, mark_inner: np.ndarray) -> np.ndarray:
    """What whole lines that are not blank add to their texts: a row of COUNTS each."""
    sums = sums.copy()
    sums[:, AT["inner"]] -= mark_inner
    c = {name: sums[:, i] for i, name in enumerate(ADDED)}
    n, inner = c["words"], c["inner"]
    cells = np.maximum.reduce([c["commas"], c["tabs"], c["pipes"] - 1, c["semis"], c["gaps"]]) + 1
    entry = (marked | (~ended & (inner == 0)) | (n <= 6)) & (n <= 14) & (inner == 0) & ~speaker
    more = [np.ones(len(sums), np.int64), ended, marked, n * entry, entry, (c["keyed"] >= 2) & (inner == 0), speaker, (cells >= 2) & (n <= 6 * cells), *[c[d] > 0 for d in DELIMITERS], *[c[d] ** 2 for d in DELIMITERS]]
    return np.column_stack([sums, *[np.asarray(x, np.int64) for x in more]])


# -- ends of segments --------------------------------------------------------------------------------------------------

_PLACES = 21


def cuts(text: str, known_left: bool = False, known_right: bool = False) -> list[int]:
    """The places of a piece of a line at which a segment certainly ends.

    Of every REACH neighbouring places of a line the one of least value (the last of them) is a cut, and nothing else is. The
    value is a hash of the CONTEXT characters before a place, and a place after white space comes before any other, so words
    are cut only where REACH characters hold no space. Every cut that is not told here, for lack of what lies beyond the piece,
    lies before the first or after the last one told. known_left: the piece begins with CONTEXT characters before a known cut;
    known_right: it ends at one. Those are not told again.
    """
    n = len(text) - CONTEXT + known_right
    if n <= 0 or n < REACH and not (known_left or known_right):
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(CONTEXT):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    tight = ~(_classes(codes[CONTEXT - 1 : CONTEXT - 1 + n].astype(np.uint32)) & _SPACE > 0)
    # Value and place in one number, so that the least is the last of equal values.
    key = ((h >> np.uint64(_PLACES + 1)) | (tight.astype(np.uint64) << np.uint64(63 - _PLACES))) << np.uint64(_PLACES)
    key |= np.uint64(2**_PLACES - 1) - np.arange(n, dtype=np.uint64)
    most = np.uint64(2**64 - 1)
    pad = np.full(REACH - 1, most)
    key = np.concatenate([*([pad] if known_left else []), key, *([pad] if known_right else [])])
    if len(key) < REACH:
        return []
    windows = len(key) - REACH + 1
    blocks = np.concatenate([key, np.full(-len(key) % REACH, most)]).reshape(-1, REACH)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.unique(np.minimum(behind[:windows], ahead[REACH - 1 : REACH - 1 + windows]))
    places = (np.uint64(2**_PLACES - 1) - (least & np.uint64(2**_PLACES - 1))).astype(np.int64) + CONTEXT
    ends = ({CONTEXT} if known_left else set()) | ({len(text)} if known_right else set())
    return sorted(set(places.tolist()) - ends)


def split(line: str) -> list[str]:
    """The segments of a whole line."""
    if len(line) < REACH + CONTEXT:
        return [line]
    at = [0, *cuts(line), len(line)]
    return [line[a:b] for a, b in zip(at, at[1:], strict=False)]


# -- states ------------------------------------------------------------------------------------------------------------

_BASE = 0xD6E8FEB86659FD93


@dataclass
class Part:
    """Neighbouring finished segments of one line; none, where size is 0."""

    size: int
    sums: np.ndarray
    marked: bool
    speaker: bool
    ended: bool
    mark_inner: int
    digest: int
    power: int
    words: Sequence
    runs: np.ndarray


def part(segments: list[str]) -> Part:
    m = measure(segments)
    digest, power = 0, 1
    for d in m.digest.tolist():
        digest, power = (digest * _BASE + d) % 2**64, power * _BASE % 2**64
    return Part(len(segments), m.sums.sum(axis=0), bool(m.marked[0]), bool(m.speaker[0]), bool(m.ended[-1]), int(m.mark_inner[0]), digest, power, sequence(m.word, WINDOW), _least(_runs(m.word)))


def _after(a: Part, b: Part) -> Part:
    """The segments of a and then b; associative."""
    if not a.size or not b.size:
        return a if a.size else b
    across = _runs(np.concatenate([a.words.last[-(RUN - 1) :], b.words.first[: RUN - 1]]))
    digest = (a.digest * b.power + b.digest) % 2**64
    return Part(a.size + b.size, a.sums + b.sums, a.marked, a.speaker, b.ended, a.mark_inner, digest, a.power * b.power % 2**64, follow(a.words, b.words, WINDOW), _least(np.concatenate([a.runs, b.runs, across])))


_EMPTY = Part(0, np.zeros(len(ADDED), np.int64), False, False, False, 0, 0, 1, Sequence(), _NONE)


@dataclass
class Piece:
    """A piece of a line: text up to its first cut (all of it, if no cut is known), the finished segments, and the text
    after the last cut with what stands before that. Both texts are bounded by some REACH characters."""

    left: str = ""
    done: Part | None = None
    right: str = ""
    context: str = ""


def piece(text: str) -> Piece:
    at = cuts(text)
    if not at:
        return Piece(text)
    done = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
    # The first cut may also be the last: then no segment is finished, but its place is known.
    return Piece(text[: at[0]], part(done) if done else _EMPTY, text[at[-1] :], text[at[-1] - CONTEXT : at[-1]])


def _join(a: Piece, b: Piece) -> Piece:
    """The piece of a and then b; associative."""
    if a.done is None and b.done is None:
        return piece(a.left + b.left)
    if a.done is None:
        text = a.left + b.left
        at = [*cuts(text, known_right=True), len(text)]
        done = [text[x:y] for x, y in zip(at, at[1:], strict=False)]
        return Piece(text[: at[0]], _after(part(done) if done else _EMPTY, b.done), b.right, b.context)
    text = a.context + a.right + b.left
    at = [CONTEXT, *cuts(text, known_left=True, known_right=b.done is not None), *([len(text)] if b.done is not None else [])]
    done = [text[x:y] for x, y in zip(at, at[1:], strict=False)]
    grown = _after(a.done, part(done) if done else _EMPTY)
    if b.done is not None:
        return Piece(a.left, _after(grown, b.done), b.right, b.context)
    return Piece(a.left, grown, text[at[-1] :], text[at[-1] - CONTEXT : at[-1]])


def _finish(p: Piece) -> Part:
    """All segments of a piece that is a whole line."""
    if p.done is None:
        return part([p.left])
    return _after(_after(part([p.left]), p.done), part([p.right]))


@dataclass
class State:
    """Counts of the finished lines, and the unfinished first and last line (the same one where no line ended)."""

    counts: np.ndarray = field(default_factory=lambda: np.zeros(len(COUNTS), np.int64))
    words: Sequence = field(default_factory=Sequence)
    lines: Sequence = field(default_factory=Sequence)
    runs: np.ndarray = field(default_factory=_NONE.copy)
    head: Piece = field(default_factory=Piece)
    tail: Piece | None = None


def _of(lines: list[str]) -> State:
    """The state of finished lines."""
    long = [i for i, x in enumerate(lines) if len(x) >= REACH + CONTEXT]
    out, at = State(), 0
    for i in [*long, len(lines)]:
        if i > at:
            m = measure(lines[at:i])
            keep = ~m.blank
            counts = line_counts(m.sums[keep], m.marked[keep], m.speaker[keep], m.ended[keep], m.mark_inner[keep]).sum(axis=0)
            word = m.word[keep[m.segment]]
            out = _add(out, State(counts, sequence(word, WINDOW), sequence(m.digest[keep], WINDOW_LINES), _least(_runs(word))))
        if i < len(lines):
            out = _add(out, _line(part(split(lines[i]))))
        at = i + 1
    return out


def _line(p: Part) -> State:
    """The state of one line of finished segments."""
    if not p.sums[AT["visible"]]:
        return State()
    one = lambda x: np.array([x])
    counts = line_counts(p.sums[None, :], one(p.marked), one(p.speaker), one(p.ended), one(p.mark_inner))[0]
    return State(counts, p.words, sequence(np.array([p.digest], np.uint64), WINDOW_LINES), p.runs)


def _add(a: State, b: State) -> State:
    """The counts of a and then b, without their borders."""
    across = _runs(np.concatenate([a.words.last[-(RUN - 1) :], b.words.first[: RUN - 1]]))
    runs = _least(np.concatenate([a.runs, b.runs, across]))
    return State(a.counts + b.counts, follow(a.words, b.words, WINDOW), follow(a.lines, b.lines, WINDOW_LINES), runs)


def count(text: str) -> State:
    """The state of one chunk."""
    parts = _LINE_END.split(text)
    s = _of(parts[1:-1])
    s.head = piece(parts[0])
    if len(parts) > 1:
        s.tail = piece(parts[-1])
    return s


def merge(a: State, b: State) -> State:
    """The state of two neighbouring chunks; associative, and no larger than either by more than a constant."""
    joint = _join(a.head if a.tail is None else a.tail, b.head)
    if a.tail is None or b.tail is None:
        out = _add(a, b)
        out.head, out.tail = (joint, b.tail) if a.tail is None else (a.head, joint)
    else:
        out = _add(_add(a, _line(_finish(joint))), b)
        out.head, out.tail = a.head, b.tail
    return out


def close(s: State) -> State:
    """The state with its border lines counted."""
    out = _add(_line(_finish(s.head)), s)
    return out if s.tail is None else _add(out, _line(_finish(s.tail)))


# -- figures -----------------------------------------------------------------------------------------------------------

#: Shares of different words, lines and runs, overall and by window.
SHARES = ["distinct_words", "distinct_lines", "window_words", "window_lines", "distinct_runs"]


def shares(s: State) -> list[float]:
    n, lines = int(s.counts[COUNTS.index("words")]), int(s.counts[COUNTS.index("lines")])
    per = lambda a, b: a / b if b else 0.0
    return [per(_distinct(s.words.least, n), n), per(_distinct(s.lines.least, lines), lines), window_share(s.words, WINDOW), window_share(s.lines, WINDOW_LINES), per(_distinct(s.runs, n), max(0, n - RUN + 1))]


def ratios(counts: np.ndarray, shares_: np.ndarray) -> pd.DataFrame:
    """Figures of many texts: counts has a row of COUNTS each, shares_ one of SHARES; 0 where there is nothing to divide by."""
    c = {name: counts[:, i].astype(float) for i, name in enumerate(COUNTS)}

    def per(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)

    def steady(name: str) -> np.ndarray:
        """Share of the lines with the delimiter, where their number of delimiters hardly varies; else 0."""
        k = c[f"{name}_lines"]
        mean = per(c[name], k)
        var = np.maximum(0.0, per(c[f"{name}2"], k) - mean * mean)
        return np.where((k >= 2) & (np.sqrt(var) <= 0.35 * mean + 0.3), per(k, c["lines"]), 0.0)

    lines, n, visible = c["lines"], c["words"], c["visible"]
    out = {
        "lines": counts[:, COUNTS.index("lines")], "words": counts[:, COUNTS.index("words")],
        "mean_word_length": per(c["wordlen"], n), "symbol_ratio": per(visible - c["letters"] - c["digits"], visible), "digit_ratio": per(c["digits"], visible), "letter_ratio": per(c["letters"], visible),
        "ended_share": per(c["ended"], lines), "common_share": per(c["common"], n), **{name: shares_[:, i] for i, name in enumerate(SHARES)},
        "words_per_line": per(n, lines), "marked_share": per(c["marked"], lines), "entry_share": per(c["entries"], lines), "entry_word_share": per(c["entry_words"], n), "sentence_rate": per(c["ended"] + c["inner"], n),
        "tag_share": per(c["tags"], visible), "hex_share": per(c["hexes"], visible), "keyed_share": per(c["keyed_lines"], lines), "speaker_share": per(c["speakers"], lines), "long_word_share": per(c["long_words"], n),
        "garbled_share": per(c["garbled"], visible), "vowel_share": per(c["vowels"], c["letters"]), **{f"{d[:-1]}_steady": steady(d) for d in DELIMITERS}, "comma_mean": per(c["commas"], c["commas_lines"]), "cell_share": per(c["short_cells"], lines),
    }
    table = pd.DataFrame(out)
    names = list(out)
    table["kind"] = [kind(dict(zip(names, row, strict=True))) for row in table.itertuples(index=False)]
    return table


def figures(s: State) -> dict:
    """Figures and kind of a closed state."""
    return ratios(s.counts[None, :], np.array([shares(s)])).iloc[0].to_dict()


def _different(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Different values per group of 0..n-1."""
    keys = np.unique((values * np.uint64(0x9E3779B97F4A7C15) ^ values >> np.uint64(31)) * np.uint64(2) + np.uint64(1) + group.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), return_index=True)[1]
    return np.bincount(group[keys], minlength=n)[:n]


def whole(texts: list[str]) -> pd.DataFrame:
    """Figures of texts that are counted where they are read, all at once."""
    n = len(texts)
    lines = [_LINE_END.split(x) for x in texts]
    plain = np.array([max(map(len, x)) < REACH + CONTEXT for x in lines], bool)
    flat = [x for p, ls in zip(plain, lines, strict=True) if p for x in ls]
    of = np.repeat(np.flatnonzero(plain), [len(ls) for p, ls in zip(plain, lines, strict=True) if p])
    m = measure(flat)
    keep = ~m.blank
    rows = line_counts(m.sums[keep], m.marked[keep], m.speaker[keep], m.ended[keep], m.mark_inner[keep])
    line_of, word_of = of[keep], of[m.segment] if len(m.segment) else np.empty(0, np.int64)
    counts = np.zeros((n, len(COUNTS)), np.int64)
    np.add.at(counts, line_of, rows)
    words, kept = counts[:, COUNTS.index("words")], counts[:, COUNTS.index("lines")]
    per = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    by_word, by_line = per(_different(word_of, m.word, n), words), per(_different(line_of, m.digest[keep], n), kept)
    run = _runs(m.word)
    inside = word_of[: len(run)] == word_of[RUN - 1 :] if len(run) else np.empty(0, bool)
    by_run = per(_different(word_of[: len(run)][inside], run[inside], n), np.maximum(0, words - RUN + 1))
    found_shares = np.column_stack([by_word, by_line, by_word, by_line, by_run])
    # Longer texts, and those with long lines, have more than one window or need estimates.
    for k in np.flatnonzero(~plain | (words > WINDOW) | (kept > WINDOW_LINES)).tolist():
        s = _of(lines[k])
        counts[k], found_shares[k] = s.counts, shares(s)
    return ratios(counts, found_shares)


def kind(f: dict) -> str:
    """The rule outcome.

    Junk: no letters to speak of, markup or hexadecimal for the most part, words too long to be words, a handful of
    words or lines or a longer block endlessly repeated, or hardly a function word of the known languages outside tables.
    Table: nearly all lines are short cells, or keyed, with a steady number of delimiters.
    List: few words to a line, hardly a sentence, most lines entries.
    """
    if f["lines"] == 0 or f["words"] == 0:
        return "junk"
    if f["tag_share"] > 0.5 or f["hex_share"] > 0.6 and f["common_share"] < 0.05 or f["long_word_share"] > 0.2 or f["garbled_share"] > 0.05 or f["letter_ratio"] + f["digit_ratio"] < 0.4:
        return "junk"
    if f["words"] >= 30 and (f["window_words"] <= 0.08 or f["distinct_runs"] <= 0.08 or f["window_lines"] <= 0.25 and f["lines"] >= 8):
        return "junk"
    steady = max(f["comma_steady"], f["tab_steady"], f["pipe_steady"], f["semi_steady"], f["gap_steady"])
    tabular = f["lines"] >= 3 and f["sentence_rate"] < 0.02 and (f["cell_share"] >= 0.7 and steady >= 0.6 or f["keyed_share"] >= 0.6)
    if tabular and (f["common_share"] >= 0.1 or f["digit_ratio"] >= 0.08 or f["lines"] >= 5):
        return "table"
    if f["common_share"] < 0.13:
        return "junk"
    entries = f["entry_word_share"] >= 0.5 and f["ended_share"] <= 0.45 and (f["marked_share"] >= 0.6 or f["entry_share"] >= 0.75)
    if f["lines"] >= 4 and f["words_per_line"] <= 8 and f["speaker_share"] < 0.5 and entries:
        return "list"
    return "prose"


# -- Spark side ------------------------------------------------------------------------------------------------------

#: Texts, of one chunk at most, that are counted at once.
BATCH = 512
FIGURES = [k for k in figures(State()) if k != "kind"]


def _count_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "chunk": pdf["chunk"], "state": [pickle.dumps(count(x)) for x in pdf["part"]]})


def _merge_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
    states = [pickle.loads(x) for x in pdf.sort_values("chunk")["state"]]
    total = states[0]
    for s in states[1:]:
        total = merge(total, s)
    return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "chunk": pdf["chunk"].iloc[:1] // FAN_IN, "state": [pickle.dumps(total)]})


def _table(ids: pd.Series, table: pd.DataFrame) -> pd.DataFrame:
    table.insert(0, "doc_id", ids.values)
    return table


def _derive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        states = [close(pickle.loads(x)) for x in pdf["state"]]
        yield _table(pdf["doc_id"], ratios(np.array([s.counts for s in states]).reshape(-1, len(COUNTS)), np.array([shares(s) for s in states]).reshape(-1, len(SHARES))))


def _derive_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for a in range(0, len(pdf), BATCH):
            some = pdf.iloc[a : a + BATCH]
            yield _table(some["doc_id"], whole(some["text"].tolist()))


_STATES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("state", T.BinaryType())])
_FIGURES = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType() if c in ("lines", "words") else T.DoubleType()) for c in FIGURES], T.StructField("kind", T.StringType())])


def statistics(documents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row of figures and kind per doc_id. An empty text has no words and is junk; null texts are left out.

    Texts of at most one chunk are counted and closed where they are read. Longer ones are cut, and their states meet
    by 32 at a time, level by level, so neither a text's chunks nor their states ever gather in one task.
    """
    texts = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = F.greatest(F.ceil(F.length("text") / chunk), F.lit(1)).cast("int")
    sized = texts.withColumn("pieces", pieces)
    small = sized.where("pieces = 1").select("doc_id", "text").mapInPandas(_derive_whole, _FIGURES)
    most = sized.agg(F.max("pieces")).first()[0] or 1
    if most == 1:
        return small
    cut = sized.where("pieces > 1").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("i"))
    cut = cut.select("doc_id", F.col("i").cast("long").alias("chunk"), F.substring("text", F.col("i") * chunk + 1, F.lit(chunk)).alias("part"))
    states = durable(cut.repartition("doc_id", "chunk").mapInPandas(_count_chunks, _STATES), "p10-states")
    while most > 1:
        states = states.groupBy("doc_id", F.floor(F.col("chunk") / FAN_IN).alias("g")).applyInPandas(_merge_chunks, _STATES)
        most = -(-most // FAN_IN)
    return small.unionByName(states.mapInPandas(_derive, _FIGURES))


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, kind) of the documents that are no prose."""
    return statistics(documents).where("kind != 'prose'").select("doc_id", "kind")
