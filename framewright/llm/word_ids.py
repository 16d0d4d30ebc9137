"""Token ids of whole texts, put together from the ids of their words by array operations.

Both kinds of tokenizer used here never let a token reach from a word into the white space after it, so a text may be cut
before every space or line end. The library encodes each distinct word once; its ids stay in a hash table of bounded
size, in arrays, so that an entry takes some 30 bytes and a chunk of texts is looked up without a step per word.
"""

import numpy as np

from framewright.llm.common import process_cache
from framewright.llm.words import code_points, mix, span_hashes

#: Longest word that is looked up by its hash; texts with longer ones go to the library whole. Words that one call of the library encodes together.
LONGEST, TOGETHER = 96, 64
SPACE, LINE = 0x20, 0x0A


class WordIds:
    """`joined` tells whether a word is encoded with the space or line end before it, as byte-level tokenizers do, or without.

    Only texts for which cutting is exact are cut; `fit` says which. 2**`bits` entries at most, cleared when two thirds are taken.
    """

    def __init__(self, path: str, joined: bool, bits: int = 21) -> None:
        from framewright.llm.bpe import load

        self.tokenizer, self.joined, self.bits = load(path), joined, bits
        self.breaks = np.arange(1, 0x110001, dtype=np.uint64)
        self.breaks[[SPACE, LINE]] = 0
        # white space other than single spaces and line ends, and characters that engines class differently
        self.odd = np.zeros(0x110000, bool)
        self.odd[[0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
        # tokens that begin a word with the space before it, or that end a run of letters
        names = sorted(self.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda t: t[1])
        self.edge = np.zeros(names[-1][1] + 1, bool)
        self.edge[[i for t, i in names if (t.startswith("\u0120") if joined else t.endswith("</w>"))]] = True
        self.clear()

    @classmethod
    def kept(cls, path: str, joined: bool, bits: int = 21) -> "WordIds":
        cache = process_cache("tokens")
        return cache.get(("word_ids", path)) or cache.setdefault(("word_ids", path), cls(path, joined, bits))

    def clear(self) -> None:
        self.keys, self.places = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint32)
        self.sizes, self.taken = np.zeros(1 << self.bits, np.uint16), 0
        self.pool, self.used = np.zeros(4 << self.bits, np.uint32), 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key, -1 where it has none."""
        out, todo = np.full(len(keys), -1), np.arange(len(keys))
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = at[hit]
            on = ~hit & (there != 0)
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
        return out

    def add(self, keys: np.ndarray, words: list[str]) -> None:
        """Encode distinct words and keep their ids."""
        sizes, flat = self.encoded(words)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.taken += len(keys)
        todo, at = np.arange(len(keys)), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[todo[free]]  # of several that want a slot the last one gets it
            got = self.keys[at] == keys[todo]
            self.places[at[got]], self.sizes[at[got]] = starts[todo[got]], sizes[todo[got]]
            todo, at = todo[~got], (at[~got] + 1) & (len(self.keys) - 1)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids one after the other).

        Plain words are given to the library many at a time, as one text. Each of them has at least one token at an edge of a word, so if
        there are as many such tokens as words, these are their borders; where there are more, the words are encoded one by one.
        """
        plain = [w for w in words if w[0] == " " and "<" not in w] if self.joined else [w for w in words if w.isalpha()]
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        found: dict[str, np.ndarray] = {}
        for group, ids in zip(groups, self.whole([("" if self.joined else " ").join(g) for g in groups])):
            edges = np.flatnonzero(self.edge[ids])
            borders = np.r_[edges, len(ids)] if self.joined else np.r_[0, edges + 1]
            if len(edges) == len(group) and borders[0] == 0 and borders[-1] == len(ids):
                borders = borders.tolist()
                found.update(zip(group, [ids[a:b] for a, b in zip(borders, borders[1:])]))
        rest = [w for w in words if w not in found]
        found.update(zip(rest, self.whole(rest)))
        parts = [found[w] for w in words]
        return np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate([np.zeros(0, "<u4"), *parts])

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def fit(self, codes: np.ndarray, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts may be cut into words."""
        good = np.ones(len(offsets), bool)
        good[owner[ends - starts > LONGEST]] = False
        if self.joined:
            # every space or line end of the text must stand between two words
            bounds = np.r_[offsets[1:] - 1, len(codes)]
            good &= np.bincount(owner, minlength=len(offsets)) == 1 + np.add.reduceat(np.r_[self.breaks[codes] == 0, False].astype(np.int64), offsets) - (bounds < len(codes))
            good[np.searchsorted(offsets, np.flatnonzero(self.odd[codes]), "right") - 1] = False
        return good

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers, as the library gives them; null is empty."""
        codes, offsets = code_points(texts)
        h, owner, starts, ends = span_hashes(codes, offsets, self.breaks)
        good = self.fit(codes, owner, starts, ends, offsets)
        rest = [i for i in np.flatnonzero(~good) if texts[i]]
        given = dict(zip(rest, self.whole([texts[i] for i in rest])))
        use = good[owner]
        h, owner, starts, ends = h[use], owner[use], starts[use], ends[use]
        if self.joined:
            before = np.where(starts > offsets[owner], codes[starts - 1], 0).astype(np.uint64)
            h = mix(h + before * np.uint64(0x9E3779B97F4A7C15))
            starts = starts - (before > 0)
        h = np.maximum(h, np.uint64(1))
        at = self.slots(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            keys, first = np.unique(h[missing], return_index=True)
            if 3 * (self.taken + len(keys)) > 2 * len(self.keys):
                self.clear()
                keys, first = np.unique(h, return_index=True)
                missing = np.arange(len(h))
            while 3 * len(keys) > 2 * len(self.keys):  # a chunk with more distinct words than the table takes
                self.bits += 1
                self.clear()
            own, a, b = owner[missing[first]], starts[missing[first]], ends[missing[first]]
            words = [texts[i][s:e] for i, s, e in zip(own.tolist(), (a - offsets[own]).tolist(), (b - offsets[own]).tolist())]
            self.add(keys, words)
            at[missing] = self.slots(h[missing])
        sizes = self.sizes[at].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.pool[np.repeat(self.places[at].astype(np.int64) - (ends - sizes), sizes) + np.arange(total)]
        cuts = np.r_[0, np.cumsum(np.bincount(owner, sizes, minlength=len(texts)).astype(np.int64))]
        return [given[i].tobytes() if i in given else flat[a:b].tobytes() for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))]
