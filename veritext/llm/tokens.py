"""Token ids of whole texts with the public ``tokenizers`` library.

A text is cut before single spaces and around single line ends that stand between two characters
other than white space, and before marks that follow a letter or digit. The tokenizer's own first
cut always falls there too, so each stretch can be encoded by itself, and stretches that repeat
are encoded once for each worker (a table of bounded size, looked up with array operations by a
64-bit hash). Texts in which another cut could matter (other white space, more than one space,
a special token's name, a stretch of more than 64 bytes) go through the library whole. Tests hold
both ways equal.
"""

from __future__ import annotations

import os

import numpy as np

END_ID = 0
SLOTS = 1 << 21
LONGEST = 64
_rng = np.random.default_rng(41)
_BYTE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[10, 32]] = True
_ODD = np.zeros(256, dtype=bool)
_ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True
#: Marks that, after a letter or digit, begin a new unit of the tokenizer's own first cut.
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?&*#%$|")] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _up_down(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _wide_spaces(b: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII."""
    at = np.flatnonzero((b == 0xC2) | ((b >= 0xE1) & (b <= 0xE3)))
    at = at[at + 2 < len(b)]
    x, y, z = b[at], b[at + 1], b[at + 2]
    wide = (x == 0xC2) & ((y == 0x85) | (y == 0xA0)) | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
    wide |= (x == 0xE2) & ((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (y == 0x81) & (z == 0x9F))
    return at[wide]


class Table:
    """Hashes to slot numbers by open addressing."""

    def __init__(self) -> None:
        self.keys, self.values, self.n = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        k = self.keys[at]
        out = np.where(k == h, self.values[at], -1).astype(np.int64)
        open_ = np.flatnonzero((k != h) & (k != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (SLOTS - 1)
            k = self.keys[at[open_]]
            hit = k == h[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (k != 0)]
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """New, distinct hashes."""
        at = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = self.keys[at[todo]] == 0
            place, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[place], self.values[place] = h[won], values[won]
            rest = np.ones(len(h), dtype=bool)
            rest[won] = False
            todo = todo[rest[todo]]
            at[todo] = (at[todo] + 1) & (SLOTS - 1)
        self.n += len(h)


class Encoder:
    """Encodes lists of texts to flat int32 ids and their offsets; keep one for each worker."""

    def __init__(self, path: str, cache: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.cache = min(cache, SLOTS // 2)
        self.line, self.tab = self._alone("\n"), self._alone("\t")
        if len(self.tab) != 1:
            raise ValueError("the tokenizer must be a byte-level BPE that keeps a tab apart")
        self._reset()

    def _alone(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.int32)

    def _reset(self) -> None:
        self.table = Table()
        self.ids = self.line  # slot 0 is the line end
        self.starts = np.array([0, len(self.line)], dtype=np.int64)
        self.hashes, self.hits = np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.int64)
        self.bytes, self.places = np.zeros(0, dtype=np.uint8), np.zeros(2, dtype=np.int64)

    def _trim(self) -> None:
        """Keep the stretches that were met again; start afresh where those are too many as well."""
        keep = self.hits > 1
        keep[0] = True
        lens, ids, hashes, sizes, held = np.diff(self.starts), self.ids, self.hashes, np.diff(self.places), self.bytes
        self._reset()
        if keep.sum() <= self.cache // 2:
            self.ids = ids[np.repeat(keep, lens)]
            self.starts = np.concatenate([[0], np.cumsum(lens[keep])])
            self.hashes, self.hits = hashes[keep], np.zeros(int(keep.sum()), dtype=np.int64)
            self.bytes, self.places = held[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])])
            self.table.add(self.hashes[1:], np.arange(1, len(self.hashes), dtype=np.int32))

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        """Encode new stretches in one go, parted by tabs (none holds one)."""
        ids = np.array(self.tok.encode_batch_fast(["\t".join(words)], add_special_tokens=False)[0].ids, dtype=np.int32)
        at = np.flatnonzero(ids == self.tab[0])
        if len(at) != len(words) - 1:
            raise RuntimeError("the tokenizer doesn't keep tabs apart")
        lens = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
        base = len(self.hashes)
        self.ids = np.concatenate([self.ids, np.delete(ids, at)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lens)])
        self.hashes = np.concatenate([self.hashes, hashes])
        self.hits = np.concatenate([self.hits, np.zeros(len(words), dtype=np.int64)])
        raw = [w.encode() for w in words]
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(raw), dtype=np.uint8)])
        self.places = np.concatenate([self.places, self.places[-1] + np.cumsum([len(r) for r in raw])])
        self.table.add(hashes, np.arange(base, base + len(words), dtype=np.int32))

    def _others(self, b: np.ndarray, start: np.ndarray, end: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Which stretches of ``b`` aren't the ones of their slots: the hashes agree by chance, length or bytes don't."""
        size = end - start
        wrong = size != self.places[slot + 1] - self.places[slot]
        same = np.flatnonzero(~wrong)
        size = size[same]
        first = np.cumsum(size) - size
        run = np.arange(int(size.sum()))
        differ = b[run + np.repeat(start[same] - first, size)] != self.bytes[run + np.repeat(self.places[slot[same]] - first, size)]
        wrong[same[np.repeat(np.arange(len(same)), size)[differ]]] = True
        return wrong

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and for each text where its ids begin (one more entry than texts)."""
        if not texts:
            return self.ids[:0], np.zeros(1, dtype=np.int64)
        if self.table.n > self.cache:
            self._trim()
        raws = [t.encode() for t in texts]
        raw = b"\n" + b"\n".join(raws) + b"\n"  # a line end before and behind each text
        b = np.frombuffer(raw, dtype=np.uint8)
        sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        ends = np.cumsum(sizes + 1)  # place of the line end behind each text
        space = _SPACE[b]
        odd = np.zeros(len(texts), dtype=bool)
        for places in (np.flatnonzero(space[1:] & space[:-1]) + 1, np.flatnonzero(_ODD[b]), _wide_spaces(b)):
            odd[np.searchsorted(ends, places)] = True
        for s in self.special:
            if s in raw:
                odd |= np.array([s in r for r in raws])
        turn = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = turn[::2], turn[1::2]
        doc = np.searchsorted(ends, start)
        # the tail: marks at the end of a word, where they follow an ASCII or Latin-1 letter or a digit
        tail = end.copy()
        more = np.flatnonzero(_MARK[b[end - 1]]) if len(end) else end
        while len(more):
            tail[more] -= 1
            more = more[(tail[more] > start[more]) & _MARK[b[tail[more] - 1]]]
        last, before = b[tail - 1], b[np.maximum(tail - 2, 0)]
        letter = _ALNUM[last] | (before == 0xC3) & (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7)
        split = (tail < end) & (tail > start) & letter
        core = np.where(split, tail, end)
        line = (b[start - 1] == 10) & (np.concatenate([[-1], doc[:-1]]) == doc) if len(start) else np.zeros(0, dtype=bool)
        spaced = b[start - 1] == 32
        odd[doc[(core - start > LONGEST) | (end - core > LONGEST)]] = True
        upto = np.zeros(len(b) + 1, dtype=np.uint64)
        up, down = _up_down(len(b))
        np.cumsum(_BYTE[b] * up, out=upto[1:])

        def hashed(s: np.ndarray, e: np.ndarray, lead: np.ndarray) -> np.ndarray:
            h = _mix((upto[e] - upto[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lead.astype(np.uint64))
            return np.where(h == 0, np.uint64(1), h)

        good = ~odd[doc]
        start, end, core, split, line, spaced, doc = (x[good] for x in (start, end, core, split, line, spaced, doc))
        n = line.astype(np.int64) + 1 + split
        first = np.cumsum(n) - n
        total = int(n.sum())
        h, s_at, e_at, lead = np.zeros(total, np.uint64), np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, bool)
        at = first + line
        h[at], s_at[at], e_at[at], lead[at] = hashed(start, core, spaced), start, core, spaced
        at = at[split] + 1
        h[at], s_at[at], e_at[at] = hashed(core[split], end[split], np.zeros(len(at), bool)), core[split], end[split]
        slot = np.zeros(total, dtype=np.int64)
        word = h != 0
        found = self.table.find(h[word])
        missed = np.flatnonzero(word)[found < 0]
        slot[word] = found
        if len(missed):
            new, one = np.unique(h[missed], return_index=True)
            k = missed[one]
            parts = zip(s_at[k].tolist(), e_at[k].tolist(), lead[k].tolist())
            self._learn([(" " if x else "") + raw[s:e].decode() for s, e, x in parts], new)
            slot[missed] = self.table.find(h[missed])
        at = np.flatnonzero(word)
        wrong = at[self._others(b, s_at[at] - lead[at], e_at[at], slot[at])]
        odd[np.repeat(doc, n)[wrong]] = True  # left to the library
        self.hits += np.bincount(slot, minlength=len(self.hits))
        lens = self.starts[slot + 1] - self.starts[slot]
        stop = np.cumsum(lens)
        count = int(stop[-1]) if total else 0
        flat = self.ids[np.arange(count) + np.repeat(self.starts[slot] - (stop - lens), lens)] if count else self.ids[:0]
        per_doc = np.bincount(np.repeat(doc, n), lens, len(texts)).astype(np.int64) if total else np.zeros(len(texts), np.int64)
        offsets = np.concatenate([[0], np.cumsum(per_doc)])
        whole = np.flatnonzero(odd)
        if not len(whole):
            return flat, offsets
        got = self.tok.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False)
        by = {int(k): np.array(e.ids, dtype=np.int32) for k, e in zip(whole, got)}
        pieces = [by[i] if i in by else flat[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file (a Python worker serves many tasks)."""
    key = (path, os.getpid())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path)
    return _ENCODERS[key]


def text_groups(texts: list[str | None], limit: int = 1_000_000):
    """Slices (begin, end) of a list of texts with at most ``limit`` characters each, one text at least."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
