"""External induced suffix sorting with common-prefix values.

Suffixes that start a descent's end (S*) are sorted by their substrings and, where these repeat, by
sorting the string of their names in the same way. The other suffixes are induced: each suffix
taken from a priority queue puts the one before it back, with the length of the prefix that it
shares with the suffix put into the same bucket before. Queues keep ``limit`` tuples in memory and
spill sorted runs to files of the task, and the text may be a memory map; the places, names and
prefixes of S* suffixes are lists in memory, so a shard is bounded by these.

``suffix_array`` sorts a block in memory with numpy, by doubling: about 1 to 2 µs a byte.
"""

import heapq
import marshal
import tempfile
from bisect import bisect_right

import numpy as np

LIMIT = 1 << 18
BLOCK = 512


class SpillQueue:
    """Priority queue of tuples of numbers that spills sorted runs to files."""

    def __init__(self, limit: int = LIMIT):
        self.limit, self.memory, self.heads, self.size = limit, [], [], 0

    @staticmethod
    def read(file):
        file.seek(0)
        while True:
            try:
                yield from marshal.load(file)
            except EOFError:
                file.close()
                return

    def spill(self):
        self.memory.sort()
        file = tempfile.TemporaryFile()
        for k in range(0, len(self.memory), BLOCK):
            marshal.dump(self.memory[k:k + BLOCK], file)
        run = self.read(file)
        heapq.heappush(self.heads, (next(run), len(self.heads) + self.size, run))
        self.memory = []

    def push(self, item: tuple):
        if len(self.memory) >= self.limit:
            self.spill()
        heapq.heappush(self.memory, item)
        self.size += 1

    def pop(self) -> tuple:
        self.size -= 1
        if self.heads and (not self.memory or self.heads[0][0] < self.memory[0]):
            item, n, run = self.heads[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (following, n, run))
            return item
        return heapq.heappop(self.memory)

    def __len__(self):
        return self.size


class Least:
    """Least of the values since a place, for values that come one after the other."""

    def __init__(self):
        self.places, self.values = [], []

    def add(self, place: int, value: int):
        while self.values and self.values[-1] >= value:
            self.places.pop()
            self.values.pop()
        self.places.append(place)
        self.values.append(value)

    def after(self, place: int) -> int:
        return self.values[bisect_right(self.places, place)]


def shared(text, a: int, b: int) -> int:
    """Length of the common prefix of two suffixes."""
    n, end = 0, len(text) - max(a, b)
    while n < end and text[a + n] == text[b + n]:
        n += 1
    return n


def descents(text) -> list[int]:
    """S* places: a suffix less than the one after it whose neighbour before is greater."""
    found, rising = [], False
    for k in range(len(text) - 2, -1, -1):
        if text[k] < text[k + 1]:
            rising = True
        elif text[k] > text[k + 1]:
            if rising:
                found.append(k + 1)
            rising = False
    return found[::-1]


def sorted_descents(text, places: list[int], limit: int):
    """(places in the order of their suffixes, common prefix of each with the one before)."""
    queue, typed = SpillQueue(limit), {}
    for n, place in enumerate(places):
        end = places[n + 1] if n + 1 < len(places) else len(text) - 1
        key, rising = [], True
        for k in range(end, place - 1, -1):
            # of equal first symbols, the suffix of the falling kind is less
            if k < end:
                rising = text[k] < text[k + 1] or text[k] == text[k + 1] and rising
            elif n + 1 == len(places):
                rising = False
            key.append(2 * int(text[k]) + rising)
        queue.push((tuple(key[::-1]) + ((-1,) if n + 1 == len(places) else ()), n))
    names, order, name, last = [0] * len(places), [], -1, None
    while len(queue):
        key, n = queue.pop()
        name += key != last
        last, names[n] = key, name
        order.append(n)
    if name + 1 == len(places):
        same = [0] * len(places)
    else:
        order, same = [], []
        for n, length in suffixes(names, limit):
            order.append(n)
            same.append(length)
    prefix = [0]
    for before, n, length in zip(order, order[1:], same[1:]):
        a, b = before + length, n + length
        done = places[b] - places[n] if b < len(places) else 0
        if a < len(places) and b < len(places):
            prefix.append(done + shared(text, places[a], places[b]))
        else:
            prefix.append(shared(text, places[before], places[n]))
    return [places[n] for n in order], prefix


def suffixes(text, limit: int = LIMIT):
    """(place, common prefix with the suffix before) of all suffixes in order."""
    size = len(text)
    if not size:
        return
    ordered, prefix = sorted_descents(text, descents(text), limit)
    # falling suffixes, from the end of the text and the S* suffixes, upwards
    queue = SpillQueue(limit)
    for rank, place in enumerate(ordered):
        queue.push((int(text[place]), 1, rank, place, prefix[rank]))
    queue.push((int(text[size - 1]), 0, -1, size - 1, 0))
    falling = SpillQueue(limit)
    least, latest, step, last = Least(), {int(text[size - 1]): -1}, 0, None
    while len(queue):
        symbol, kind, source, place, length = queue.pop()
        if last is None or last[0] != symbol:
            length = 0
        elif last[1] != kind:
            length = shared(text, last[2], place)
        if not kind:
            falling.push((-symbol, 1, -step, place, length))
        least.add(step, length)
        last = (symbol, kind, place)
        if place and text[place - 1] >= text[place]:
            before = int(text[place - 1])
            common = 1 + least.after(latest[before]) if before in latest else 0
            latest[before] = step
            queue.push((before, 0, step, place - 1, common))
        step += 1
    # rising suffixes, from the falling ones, downwards; a falling one carries its common prefix
    # with the one below it, a rising one with the one above it
    out = SpillQueue(limit)
    queue, least, latest, step, last = falling, Least(), {}, 0, None
    while len(queue):
        symbol, kind, source, place, length = queue.pop()
        if last is None or last[0] != symbol:
            above = 0
        elif last[1] != kind:
            above = shared(text, last[2], place)
        elif kind:
            above = last[3]
        else:
            above = length
        out.push((-step, place, above))
        least.add(step, above)
        last = (symbol, kind, place, length)
        if place and (text[place - 1] < text[place] or text[place - 1] == text[place] and not kind):
            before = -int(text[place - 1])
            common = 1 + least.after(latest[before]) if before in latest else 0
            latest[before] = step
            queue.push((before, 0, step, place - 1, common))
        step += 1
    # turned round: what was shared with the one above belongs to that one
    held = 0
    while len(out):
        _, place, above = out.pop()
        yield place, held
        held = above


def repeated_places(contents: list[bytes], span: int, limit: int = LIMIT) -> list[list[bool]]:
    """For each content, which of its windows of ``span`` bytes occur twice or more in all."""
    from array import array

    # a symbol of its own ends each content, so that no common prefix runs past it
    text, begin = array("q"), []
    for n, content in enumerate(contents):
        begin.append(len(text))
        text.extend(b + len(contents) for b in content)
        text.append(n)
    flags = [[False] * max(0, len(c) - span + 1) for c in contents]

    def mark(place):
        n = bisect_right(begin, place) - 1
        flags[n][place - begin[n]] = True

    last = None
    for place, length in suffixes(text, limit):
        if length >= span:
            mark(last)
            mark(place)
        last = place
    return flags


# --- blocks in memory --------------------------------------------------------------------

FIRST = 4
SYMBOL_BITS = 9


def in_order(keys: np.ndarray, key_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of ``keys`` in order, ``keys`` in order); ``keys`` may be overwritten."""
    bits = len(keys).bit_length()
    if key_bits + bits > 64:
        turn = np.argsort(keys, kind="stable")
        return turn, keys[turn]
    keys <<= np.uint64(bits)
    keys |= np.arange(len(keys), dtype=np.uint64)
    keys.sort()
    turn = (keys & np.uint64((1 << bits) - 1)).astype(np.int32)
    keys >>= np.uint64(bits)
    return turn, keys


def suffix_array(text: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of all suffixes in order, whether each shares ``span`` symbols with the one before).

    ``text`` holds symbols below 2 ** ``SYMBOL_BITS`` - 1. Suffixes are named by their first
    symbols, a name being the first place of its group in the order; each round sorts those of
    groups that are not single yet by their name and that of the suffix as far on as names reach.
    About 60 bytes of memory a symbol.
    """
    size, reach = len(text), FIRST if span >= FIRST else 1
    if not size:
        return np.zeros(0, np.int32), np.zeros(0, bool)
    bits = np.uint64(size.bit_length())
    # the end of the text comes before all symbols
    keys = np.zeros(size, np.uint64)
    for k in range(reach):
        keys <<= np.uint64(SYMBOL_BITS)
        keys[:max(0, size - k)] |= text[k:].astype(np.uint64) + np.uint64(1)
    order, keys = in_order(keys, SYMBOL_BITS * reach)
    names, slots, held = np.zeros(size, np.int32), np.arange(size, dtype=np.int32), None
    while True:
        # of the suffixes at ``slots``, groups start where the sorted keys change
        starts = np.ones(len(slots), bool)
        starts[1:] = keys[1:] != keys[:-1]
        names[order[slots]] = np.maximum.accumulate(np.where(starts, slots, np.int32(0)))
        if reach <= span < 2 * reach:
            held, ahead = names.copy(), span - reach
        slots = slots[~(starts & np.append(starts[1:], True))]
        if not len(slots):
            break
        places = order[slots]
        keys = names[places].astype(np.uint64) << bits
        on = np.flatnonzero(places < size - reach)
        keys[on] |= names[places[on] + np.int32(reach)].astype(np.uint64) + np.uint64(1)
        turn, keys = in_order(keys, 2 * int(bits))
        order[slots] = places[turn]
        reach *= 2
    shares = np.zeros(size, bool)
    if held is not None:  # else all differ before ``span``
        a, b = order[:-1], order[1:]
        like = np.flatnonzero((held[a] == held[b]) & (np.maximum(a, b) < size - ahead))
        shares[like[held[a[like] + ahead] == held[b[like] + ahead]] + 1] = True
    return order, shares


def repeated_in_blocks(contents: list[bytes], span: int) -> list[np.ndarray]:
    """The same as ``repeated_places``, from the suffix array of all contents in memory."""
    # a symbol less than all bytes ends each content
    text = np.frombuffer(b"".join(c + b"\0" for c in contents), np.uint8).astype(np.uint16) + 1
    sizes = np.array([len(c) for c in contents], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0
    order, shares = suffix_array(text, span)
    twin = np.flatnonzero(shares)
    flags = np.zeros(len(text), bool)
    flags[order[twin]] = True
    flags[order[twin - 1]] = True
    return [flags[end - n:max(end - n, end - span + 1)] for end, n in zip(ends, sizes)]
