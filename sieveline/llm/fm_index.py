"""A compressed full-text index over word symbols: BWT in a Huffman-shaped wavelet matrix."""

from __future__ import annotations

import numpy as np

from .kernel import U


class Bits:
    """Packed bits with a directory of the ones before each 64 of them."""

    def __init__(self, bit: np.ndarray) -> None:
        words = (len(bit) >> 6) + 1
        padded = np.zeros(words * 64, np.uint8)
        padded[: len(bit)] = bit
        self.words = np.packbits(padded, bitorder="little").view(U)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & ((U(1) << (i & 63).astype(U)) - U(1)))


def code_lengths(count: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code for symbols that occur so often; 0 for none.

    Leaves by rising count and inner nodes as they are made are two sorted
    queues, from the fronts of which the two lightest are merged."""
    out = np.zeros(len(count), np.int64)
    leaf = np.flatnonzero(count)
    if len(leaf) < 2:
        out[leaf] = 1
        return out
    leaf = leaf[np.argsort(count[leaf], kind="stable")]
    weight, n = count[leaf].tolist(), len(leaf)
    inner, up_leaf, up_inner = [], [0] * n, [0] * (n - 1)
    a = b = 0
    for k in range(n - 1):
        total = 0
        for _ in range(2):
            if b >= k or a < n and weight[a] <= inner[b]:
                total += weight[a]
                up_leaf[a] = k
                a += 1
            else:
                total += inner[b]
                up_inner[b] = k
                b += 1
        inner.append(total)
    depth = [0] * (n - 1)
    for k in range(n - 3, -1, -1):
        depth[k] = depth[up_inner[k]] + 1
    out[leaf] = np.array(depth)[up_leaf] + 1
    return out


class Wavelet:
    """Wavelet matrix in the shape of a Huffman code: a symbol is in as many
    levels as its code has bits, so that all levels together have about as many
    bits as the zero-order entropy of the text.

    Codes are dealt so that, on each level, those that end there are the last in
    the level's order: the level below is the beginning of what it would be.
    """

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.length = code_lengths(np.bincount(symbols, minlength=sigma))
        self.path = np.zeros(sigma, U)  # a bit per level, the lowest first
        by_length = np.argsort(self.length, kind="stable")
        edge = np.searchsorted(self.length[by_length], np.arange(int(self.length.max(initial=0)) + 2))
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        nodes, cur = np.zeros(1, U), symbols
        for l in range(len(edge) - 2):
            nodes = np.concatenate([nodes, nodes | U(1 << l)])
            ends = by_length[edge[l + 1] : edge[l + 2]]
            if len(ends):
                self.path[ends] = nodes[-len(ends) :]
                nodes = nodes[: -len(ends)]
        for l in range(len(edge) - 2):
            bit = (self.path[cur] >> U(l)) & U(1) > 0
            self.levels.append(Bits(bit))
            self.zeros.append(len(bit) - int(bit.sum()))
            nxt = np.concatenate([cur[~bit], cur[bit]])
            cur = nxt[: len(nxt) - int((self.length[nxt] == l + 1).sum())]
        self.length, self.path = self.length.astype(np.int8), self.path.astype(np.uint32 if len(self.levels) <= 32 else U)
        every = np.arange(sigma)
        self.begin = self._down(every, np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        i, size, path = i.copy(), self.length[c], self.path[c]
        for l, bits in enumerate(self.levels):
            on = np.flatnonzero(size > l)
            if not len(on):
                break
            j = i[on]
            one = bits.rank(j)
            i[on] = np.where(path[on].astype(U) >> U(l) & U(1), self.zeros[l] + one, j - one)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before i."""
        return np.where(self.length[c] > 0, self._down(c, i) - self.begin[c], 0)


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    s = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
    return out


class FMIndex:
    """Index of pieces of text, each with the smallest document that holds it.

    vocabulary: sorted word hashes; pieces: word symbols in one array (1 and
    up) with offsets; owner: a document id per piece. Suffixes are sorted by
    more symbols than a window has, which is as far as matches are followed.
    """

    def __init__(self, vocabulary: np.ndarray, symbols: np.ndarray, ofs: np.ndarray, owner: np.ndarray, window: int) -> None:
        self.vocabulary, self.window = vocabulary, window
        lens = np.diff(ofs)
        text = np.zeros(len(symbols) + len(lens), np.int64)
        where = np.arange(len(symbols)) + np.repeat(np.arange(len(lens)), lens)
        text[where] = symbols
        n = self.n = len(text)
        sigma = len(vocabulary) + 1
        rank, by = _dense(text), {1: None}
        by[1] = rank
        k = 1
        while k <= window:
            nxt = np.full(n, 0, np.int64)
            nxt[: n - k] = by[k][k:] + 1 if n > k else 0
            by[2 * k] = _dense(by[k] * (n + 1) + nxt)
            k *= 2
        sa = np.argsort(by[k], kind="stable")
        bwt = text[sa - 1]
        bwt[sa == 0] = text[-1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = Wavelet(bwt, sigma)
        # groups of suffixes that agree on `window` symbols
        part = 1 << (window.bit_length() - 1)
        r = by[part]
        tail = np.minimum(sa + window - part, n - 1)
        new = np.ones(n, bool)
        new[1:] = (r[sa][1:] != r[sa][:-1]) | (r[tail][1:] != r[tail][:-1])
        self.marks = Bits(new)
        self.group_start = np.append(np.flatnonzero(new), n)
        doc = np.full(n, np.iinfo(np.int64).max)
        doc[where] = np.repeat(owner, lens)
        self.group_doc = np.minimum.reduceat(doc[sa], self.group_start[:-1])

    def matching(self, keys: np.ndarray, ofs: np.ndarray) -> np.ndarray:
        """Smallest owner of each window of `window` words of the given pieces.

        All pieces are streamed from right to left in lockstep, a backward
        search step each: the match grows to the left, and is cut to `window`
        words by moving to the enclosing interval at that depth. When it can't
        grow, its right end moves and the search restarts there. The result has
        a value per word; a window that isn't in the index has the largest
        int64.
        """
        none = np.iinfo(np.int64).max
        out = np.full(len(keys), none)
        at = np.minimum(np.searchsorted(self.vocabulary, keys), len(self.vocabulary) - 1)
        sym = np.where(self.vocabulary[at] == keys, at + 1, 0)
        lo_edge, hi_edge = ofs[:-1].copy(), ofs[1:].copy()
        live = np.flatnonzero(hi_edge - lo_edge >= self.window)
        base, i, e = lo_edge[live], hi_edge[live].copy(), hi_edge[live].copy()
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        while len(base):
            c = sym[i - 1]
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
            lo2, hi2 = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
            ok = (hi2 > lo2) & (c > 0)
            i = np.where(ok, i - 1, e - 1)
            e = np.where(ok, e, e - 1)
            lo, hi = np.where(ok, lo2, 0), np.where(ok, hi2, self.n)
            long = e - i > self.window
            if long.any():
                g = self.marks.rank(lo[long] + 1) - 1
                lo[long], hi[long] = self.group_start[g], self.group_start[g + 1]
                e[long] -= 1
            hit = e - i == self.window
            out[i[hit]] = self.group_doc[self.marks.rank(lo[hit] + 1) - 1]
            stay = (i > base) & (e - base >= self.window)
            if not stay.all():
                base, i, e, lo, hi = base[stay], i[stay], e[stay], lo[stay], hi[stay]
        return out
