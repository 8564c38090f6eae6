"""Pieces of byte-level BPE texts: the split before merging, ids and exact prefix counts.

The split follows the pattern of the vocabulary file. Letters and numbers are classed by the
interpreter's own Unicode tables; code points that those do not know are put to the tokenizer.
"""

import json
import os
import re
import struct
import sys
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

BYTE_BPE = "byte_bpe_50k.json"


def vocabulary_path(name: str = BYTE_BPE) -> str:
    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(None)
def unknown_letters() -> dict[int, str]:
    """Classes of the letters and numbers that are newer than the interpreter's tables."""
    split = load_tokenizer(vocabulary_path()).pre_tokenizer.pre_tokenize_str
    found = {}
    for m in regex.finditer(r"[\p{L}\p{N}]", "".join(
            chr(c) for c in range(sys.maxunicode + 1) if category(chr(c)) == "Cn")):
        kind = [k for k, other in (("L", "a"), ("N", "1")) if len(split(other + m[0])) == 1]
        found.update({ord(m[0]): k for k in kind})
    return found


@lru_cache(None)
def char_classes(top: int) -> tuple[str, str]:
    """Letters and numbers up to a code point, as bodies of a character class."""
    found = {"L": [], "N": []}
    new = unknown_letters()
    begin, kind = 0, None
    for c in range(top + 2):
        now = new.get(c, category(chr(c))[0]) if c <= top else None
        now = now if now in found else None
        if now != kind:
            if kind:
                found[kind].append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin, kind = c, now
    return "".join(found["L"]), "".join(found["N"])


#: white space as Unicode has it
SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = re.compile(f"[{SPACE}]*")
ABOVE = re.compile(r"[\U00010000-\U0010ffff]")


@lru_cache(None)
def patterns(wide: bool) -> tuple[re.Pattern, re.Pattern]:
    """(pieces, units). A piece is what is merged on its own. A unit is a run of white space and
    the piece that follows: prefix counts inside a unit depend on nothing outside it."""
    a, n = char_classes(sys.maxunicode if wide else 0xFFFF)
    pieces = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{a}]+| ?[{n}]+| ?[^{SPACE}{a}{n}]+"
              rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    quote = r"'(?:s|t|re|ve|m|ll|d)"
    units = (rf"(?:[{SPACE}]*(?! )[{SPACE}])?{quote}"
             rf"|[{SPACE}]*(?:[{a}]+|[{n}]+|[^{SPACE}{a}{n}]+)|[{SPACE}]+")
    return re.compile(pieces), re.compile(units)


def split_with(text: str) -> tuple[re.Pattern, re.Pattern]:
    """The patterns for a text; those without code points above 65,535 are much faster."""
    return patterns(not text.isascii() and ABOVE.search(text) is not None)


@lru_cache(None)
def special_tokens(path: str) -> tuple[tuple[str, int], ...]:
    with open(path, encoding="utf-8") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f)["added_tokens"])


@lru_cache(None)
def special_pattern(path: str):
    names = [re.escape(t) for t, _ in special_tokens(path)]
    return re.compile("|".join(sorted(names, key=len, reverse=True)) or r"(?!)")


def byte_alphabet() -> dict[str, int]:
    """The characters by which the vocabulary file writes bytes: printable ones stand for
    themselves, the others for the next free code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    free = 256
    for b in range(256):
        if b not in plain:
            table[chr(free)] = b
            free += 1
    return table


@lru_cache(None)
def char_kinds() -> np.ndarray:
    """Class of every code point: letter (1), number (2), white space (3) or other (0)."""
    number = {"L": 1, "N": 2}
    kinds = np.array([number.get(category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)],
                     np.uint8)
    for c, kind in unknown_letters().items():
        kinds[c] = number[kind]
    kinds[[ord(m) for m in re.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001))))]] = 3
    return kinds


ASCII = bytes(range(128))


def piece_starts(data: bytes, breaks: np.ndarray) -> np.ndarray:
    """Where the pieces of texts that lie end to end start, by bytes, and the end of the last one.

    Cuts as the first of ``patterns`` does, at all places at once. ``breaks`` has the places that
    no piece crosses, such as the starts of the texts.
    """
    raw = np.frombuffer(data + b"  ", np.uint8)
    raw, after = raw[:-2], raw[1:]
    kind = char_kinds()[raw]
    wide = raw >= 0x80
    codes = np.frombuffer(data.translate(None, ASCII).decode().encode("utf-32-le"), "<u4")
    kind[wide] = np.repeat(char_kinds()[codes], 2 + (codes >= 0x800) + (codes >= 0x10000))
    first = np.zeros(len(raw) + 1, bool)
    first[breaks] = first[0] = first[-1] = True
    start = first.copy()
    start[1:-1] |= kind[1:] != kind[:-1]
    # of white space before something else, the last character stays apart, or joins if a space
    ends = np.flatnonzero((kind[:-1] == 3) & start[1:-1] & ~first[1:-1]) + 1
    last = ends - 1
    for _ in range(2):
        last -= (raw[last] & 0xC0) == 0x80
    start[last] = True
    start[ends[raw[ends - 1] == 0x20]] = False
    # contractions, where a piece starts with the quote
    quote = np.flatnonzero(raw == ord("'"))
    quote = quote[start[quote] & ~first[quote + 1]]
    one = np.isin(after[quote], np.frombuffer(b"stmd", np.uint8))
    two = ~first[quote + 2 - one] & np.isin(
        after[quote].astype(np.int64) << 8 | after[quote + 1],
        [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])
    start[quote[one | two] + 1] = False
    start[quote[one] + 2] = True
    start[quote[two] + 3] = True
    return np.flatnonzero(start)


class IdStore:
    """Ids of texts as little-endian unsigned 32-bit bytes, with the pieces seen before kept."""

    LIMIT = 500_000
    BLOCK = 1 << 21

    def __init__(self, path: str):
        self.model = load_tokenizer(path).model
        self.names = {b: ord(c) for c, b in byte_alphabet().items()}
        self.special = {t: i.to_bytes(4, "little") for t, i in special_tokens(path)}
        self.cut = re.compile(special_pattern(path).pattern.encode())
        self.known = dict(self.special)

    def learn(self, pieces: list[str]) -> None:
        missing = [p for p in pieces if p not in self.known]
        if len(self.known) + len(missing) > self.LIMIT:
            self.known = dict(self.special)
            missing = [p for p in pieces if p not in self.known]
        # the split is done, so a piece goes straight to the library's merges
        for piece in missing:
            found = self.model.tokenize(
                piece.encode().decode("latin-1").translate(self.names))
            self.known[piece] = struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def block(self, data: bytes, ends: np.ndarray) -> Iterator[bytes]:
        """Ids of texts that lie end to end; ``ends`` has 0 and where each of them ends."""
        marks = [m.span() for begin, end in zip(ends.tolist(), ends[1:].tolist())
                 for m in self.cut.finditer(data, begin, end)]
        starts = piece_starts(data, np.concatenate([ends, *marks]).astype(np.int64))
        if marks:
            inside = np.zeros(len(data) + 1, bool)
            for begin, end in marks:
                inside[begin + 1:end] = True
            starts = starts[~inside[starts]]
        pieces = pa.LargeStringArray.from_buffers(
            len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data)).dictionary_encode()
        names, nth = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        self.learn(names)
        found = [self.known[p] for p in names]
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        begins = np.cumsum(sizes) - sizes
        upto = np.concatenate([[0], np.cumsum(sizes[nth])])
        places = np.arange(upto[-1]) + np.repeat(begins[nth] - upto[:-1], sizes[nth])
        ids = np.frombuffer(b"".join(found), "<u4")[places]
        cuts = upto[np.searchsorted(starts, ends)].tolist()
        return (ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:]))

    def each(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a column; a null counts as empty. Some MB are taken at a time."""
        texts = texts.cast(pa.large_string()).fill_null("")
        size, buffers = len(texts), texts.buffers()
        if not size:
            return
        ends = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + size + 1]
        data, at = memoryview(buffers[2] or b""), 0
        while at < size:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + self.BLOCK, "right")) - 1)
            yield from self.block(bytes(data[ends[at]:ends[to]]), ends[at:to + 1] - ends[at])
            at = to

    def ids(self, text: str) -> bytes:
        return next(self.each(pa.array([text], pa.large_string())))


class PrefixCounter:
    """Exact token counts at every prefix of a text, by dynamic programming.

    The encoding of a prefix is that of a shorter prefix and one last token; exactly one last
    token makes a pair with the token before it that merging leaves as it is. So one pass over
    the bytes gives the count at every prefix. Units of text are counted once and kept as steps.
    """

    LIMIT = 400_000

    def __init__(self, path: str):
        self.library = load_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        self.texts = {i: raw(s) for s, i in model["vocab"].items()}
        self.vocab = {b: i for i, b in self.texts.items()}
        self.rank = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = raw(a), raw(b)
            self.rank[self.vocab[a], self.vocab[b]] = (r, self.vocab[a + b])
        # tokens by their bytes from the end, so that a walk backwards meets every suffix
        self.tails: dict = {}
        for b, i in self.vocab.items():
            node = self.tails
            for x in reversed(b):
                node = node.setdefault(x, {})
            node[-1] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.steps: dict[str, bytes] = {}
        self.prefixes: dict[bytes, tuple[int, int, bytes]] = {b"": (-1, 0, b"")}
        self.cut = special_pattern(path)

    def merge(self, data: bytes) -> list[int]:
        parts = [self.vocab[data[i:i + 1]] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.rank[p], k) for k, p in enumerate(zip(parts, parts[1:]))
                        if p in self.rank), default=None)
            if best is None:
                break
            (_, joined), k = best
            parts[k:k + 2] = [joined]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether merging keeps token b apart after token a (-1: at the start)."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = (self.merge(self.texts[b]) == [b] if a < 0 else
                     self.merge(self.texts[a] + self.texts[b]) == [a, b])
            self.pairs[a, b] = known
        return known

    def prefix(self, data: bytes) -> tuple[int, int, bytes]:
        """(last token, token count, steps of the count by bytes) of a piece cut anywhere.

        Kept by prefix, as words that begin alike share the work.
        """
        known = self.prefixes
        done = len(data)
        while data[:done] not in known:
            done -= 1
        steps = known[data[:done]][2]
        before = known[data[:done]][1]
        for end in range(done + 1, len(data) + 1):
            node, found, start = self.tails, [], end
            while start:
                start -= 1
                node = node.get(data[start])
                if node is None:
                    break
                if -1 in node:
                    found.append((start, node[-1]))
            for start, token in reversed(found):
                last, count, _ = known[data[:start]]
                fit = self.pairs.get((last, token))
                if fit or fit is None and self.fits(last, token):
                    steps += (count + 1 - before).to_bytes(4, "little", signed=True)
                    before = count + 1
                    known[data[:end]] = token, before, steps
                    break
            else:
                raise ValueError("bytes without a token")
        return known[data]

    def long_prefix(self, data: bytes) -> list[int]:
        """Counts of all prefixes of a very long piece, without keeping them."""
        last, counts = [-1], [0]
        for end in range(1, len(data) + 1):
            node, found, start = self.tails, [], end
            while start:
                start -= 1
                node = node.get(data[start])
                if node is None:
                    break
                if -1 in node:
                    found.append((start, node[-1]))
            start, token = next(x for x in reversed(found) if self.fits(last[x[0]], x[1]))
            last.append(token)
            counts.append(counts[start] + 1)
        return counts[1:]

    def piece_counts(self, piece: str) -> list[int]:
        """Token counts of all prefixes of one piece, by characters."""
        data = piece.encode()
        if len(data) > 200:
            counts = self.long_prefix(data)
        else:
            counts = np.cumsum(np.frombuffer(self.prefix(data)[2], "<i4")).tolist()
        if len(data) == len(piece):
            return counts
        ends, at = [], 0
        for c in piece:
            at += len(c.encode())
            ends.append(counts[at - 1])
        return ends

    def unit_counts(self, unit: str) -> list[int]:
        """Token counts of all prefixes of a unit: white space, then at most one piece."""
        space = SPACES.match(unit)[0]
        body = unit[len(space):]
        counts = self.piece_counts(space) if space else []
        if not body:
            return counts
        pieces = split_with(unit)[0].findall(unit)
        base = sum(self.piece_counts(p)[-1] for p in pieces[:-1])
        tail = self.piece_counts(pieces[-1])
        if body[0] == "'" and len(body) > 1 and not space.endswith(" "):
            # a cut contraction is a quote and letters
            if re.fullmatch(r"'(?:s|t|re|ve|m|ll|d)", body):
                tail[1:-1] = [1 + self.piece_counts(body[1:2])[0]] * (len(body) - 2)
        tail = tail[len(pieces[-1]) - len(body):]
        return counts + [base + c for c in tail]

    def unit_steps(self, unit: str) -> bytes:
        if unit[0] == " " and len(unit) <= 50 and not SPACES.match(unit, 1)[0]:
            data = unit.encode()
            steps = self.prefix(data)[2]
            if len(data) == len(unit):
                return steps
            # steps of the bytes of a character add up
            starts = [k for k, b in enumerate(data) if b & 0xC0 != 0x80]
            return np.add.reduceat(np.frombuffer(steps, "<i4"), starts, dtype="<i4").tobytes()
        counts = self.unit_counts(unit)
        return np.diff(np.array([0, *counts], "<i4")).tobytes()

    def plain(self, text: str) -> np.ndarray:
        """Counts at every prefix of a text without special tokens."""
        units = split_with(text)[1].findall(text)
        parts = list(map(self.steps.get, units))
        if None in parts:
            if len(self.steps) >= self.LIMIT:
                self.steps.clear()
            if len(self.prefixes) >= 2 * self.LIMIT:
                self.prefixes = {b"": (-1, 0, b"")}
            for k, (unit, steps) in enumerate(zip(units, parts)):
                if steps is None:
                    steps = self.steps.get(unit) or self.unit_steps(unit)
                    if len(unit) <= 200:
                        self.steps[unit] = steps
                    parts[k] = steps
        joined = b"".join(parts)
        return np.cumsum(np.frombuffer(joined, "<i4"), dtype=np.int64)

    def counts(self, text: str) -> np.ndarray:
        """Token counts of text[:1], text[:2], ... as the library gives them."""
        out, at, base = [], 0, 0
        for m in self.cut.finditer(text):
            # a cut special token is ordinary text and joins the last unit before it
            begin, before = m.start(), base
            if begin > at:
                counts = self.plain(text[at:begin]) + base
                begin = [u.start() for u in split_with(text)[1].finditer(text, at, begin)][-1]
                before = int(counts[begin - at - 1]) if begin > at else base
                base = int(counts[-1])
                out.append(counts)
            inner = [before + int(self.plain(text[begin:k])[-1])
                     for k in range(m.start() + 1, m.end())]
            base += 1
            out.append(np.array([*inner, base], np.int64))
            at = m.end()
        if at < len(text):
            out.append(self.plain(text[at:]) + base)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


@lru_cache(1)
def prefix_counter(path: str) -> PrefixCounter:
    """The counter of this process: tasks that follow each other in a worker share what it keeps."""
    return PrefixCounter(path)
