"""A weighted finite-state transducer for SentencePiece models.

Three machines are compiled from a model file: the normaliser (longest-match
rewriting), the piece transducer (a trie whose final states emit piece ids, with
a byte-fallback arc for every character outside the alphabet), and a weight
acceptor. An input is a linear acceptor; composing it with these gives a lattice
of (start, end, piece) arcs, whose tropical-semiring (min, +) shortest path is
the encoding.

Weights. A unigram model weighs an arc by minus its score. In a merge (BPE)
model the score ranks merges and isn't additive; there the acceptor is a bigram
machine whose state is the last piece, and an arc costs 0 where the two pieces,
put side by side, are left apart by the merge rules, and infinity otherwise.
Exactly one path then has finite weight, and it is the merge encoding.

Distinct words go through the machine in batches: one numpy pass per end
position relaxes the arcs of every word at once. Results are kept in a bounded
memo, as an input breaks exactly where no piece can cross.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INF = np.int64(1 << 40)
#: Parts up to this length are relaxed in batches, longer ones one by one.
BATCH_CHARS = 40
#: Most words in the memo; beyond it the memo starts afresh (results don't depend on it).
MEMO = 300_000
#: Characters relaxed together, words of like length side by side.
CHARS = 50_000
#: Ids decoded together, or those of one longer text.
DECODE = 100_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        shift += 7
        if x < 128:
            return value, i


def _fields(b: bytes):
    """(field number, value) of a serialised message; value is bytes for lengths and 32-bit fields."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 1:
            value, i = b[i : i + 8], i + 8
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        elif kind == 5:
            value, i = b[i : i + 4], i + 4
        else:
            raise ValueError(f"wire type {kind} in a model file")
        yield key >> 3, value


def _double_array(blob: bytes) -> dict[str, str]:
    """The rewriting rules of a precompiled character map (a double-array trie and a pool of outputs)."""
    if len(blob) < 4:
        return {}
    (size,) = struct.unpack("<I", blob[:4])
    units = np.frombuffer(blob[4 : 4 + size], dtype="<u4")
    pool = blob[4 + size :]
    rules: dict[str, str] = {}

    def offset(u: int) -> int:
        return (u >> 10) << ((u & (1 << 9)) >> 6)

    stack = [(0, b"")]
    while stack:
        at, path = stack.pop()
        base = at ^ offset(int(units[at]))
        for c in range(1, 256):
            to = base ^ c
            if to >= len(units) or (int(units[to]) & ((1 << 31) | 0xFF)) != c:
                continue
            unit = int(units[to])
            if unit & (1 << 8):
                leaf = int(units[to ^ offset(unit)]) & 0x7FFFFFFF
                rules[(path + bytes([c])).decode("utf-8", "replace")] = pool[leaf : pool.index(b"\0", leaf)].decode()
            stack.append((to, path + bytes([c])))
    return rules


class Lookup:
    """Values by integer key, found by two reads of a table (cuckoo hashing), for many keys at once; ``missing`` for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.missing, bits, seed = missing, max(4, int(len(keys) * 2.2).bit_length()), 0
        while True:
            seed += 1
            self.shift = np.uint64(64 - bits)
            self.mul = [np.uint64(((2 * seed + k) * 0x9E3779B97F4A7C15 | 1) & 0xFFFFFFFFFFFFFFFF) for k in (0, 1)]
            table = self._place(keys, 1 << bits)
            if table is not None:
                break
            if seed % 8 == 0:
                bits += 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, missing, dtype=np.int64)
        for slot, i in table.items():
            self.keys[slot], self.values[slot] = keys[i], values[i]

    def _slots(self, keys: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * self.mul[k]) >> self.shift).astype(np.int64)

    def _place(self, keys: np.ndarray, size: int) -> dict[int, int] | None:
        slots = list(zip(self._slots(keys, 0).tolist(), self._slots(keys, 1).tolist()))
        table: dict[int, int] = {}
        for i in range(len(keys)):
            at, item = slots[i][0], i
            for _ in range(200):
                item, table[at] = table.get(at), item
                if item is None:
                    break
                a, b = slots[item]
                at = b if at == a else a
            else:
                return None
        return table

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        a = self._slots(keys, 0)
        out = np.where(self.keys[a] == keys, self.values[a], self.missing)
        rest = np.flatnonzero(out == self.missing)
        if len(rest):
            left = keys[rest]
            b = self._slots(left, 1)
            out[rest] = np.where(self.keys[b] == left, self.values[b], self.missing)
        return out


class Machine:
    """Encoder and decoder compiled from the bytes of a model file."""

    def __init__(self, proto: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        kind, self.dummy_prefix, self.squeeze, charsmap = UNIGRAM, True, True, b""
        self.byte_fallback = False
        for f, v in _fields(proto):
            if f == 1:
                piece, score, typ = "", 0.0, NORMAL
                for g, w in _fields(v):
                    if g == 1:
                        piece = w.decode()
                    elif g == 2:
                        (score,) = struct.unpack("<f", w)
                    elif g == 3:
                        typ = w
                self.pieces.append(piece)
                self.scores.append(score)
                self.types.append(typ)
            elif f == 2:
                for g, w in _fields(v):
                    if g == 3:
                        kind = w
                    elif g == 35:
                        self.byte_fallback = bool(w)
            elif f == 3:
                for g, w in _fields(v):
                    if g == 2:
                        charsmap = w
                    elif g == 3:
                        self.dummy_prefix = bool(w)
                    elif g == 4:
                        self.squeeze = bool(w)
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models are weighted machines")
        if USER in self.types:
            raise ValueError("user-defined pieces aren't supported")
        self.kind = kind
        self.rules = _double_array(charsmap)
        self.longest_rule = max(map(len, self.rules), default=0)
        self.unk = self.types.index(UNKNOWN)
        self.byte_id = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self._compile()

    # -- compilation

    def _compile(self) -> None:
        usable = [i for i, t in enumerate(self.types) if t == NORMAL and self.pieces[i]]
        self.id_of = {self.pieces[i]: i for i in usable}
        self.decoded = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t in (CONTROL,) else (" ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode())
            for p, t in zip(self.pieces, self.types)
        ]
        self.out_size = np.array([len(x) for x in self.decoded], dtype=np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out_bytes = np.frombuffer(b"".join(self.decoded), dtype=np.uint8)
        n = len(self.pieces)
        # runs of the space mark with the least scores are merged last, leftmost first
        self.runs = {1: self.id_of.get(SPACE, self.unk)}
        normal = [i for i in usable if set(self.pieces[i]) != {SPACE}]
        least = min((self.scores[i] for i in normal), default=0.0)
        run_pieces = {i for i in usable if self.kind == BPE and len(self.pieces[i]) > 1 and set(self.pieces[i]) == {SPACE} and self.scores[i] < least}
        for i in run_pieces:
            self.runs[len(self.pieces[i])] = i
        self.run_pieces = run_pieces
        arcs = [i for i in usable if i not in run_pieces]
        self.unknown_cost = -(min((self.scores[i] for i in arcs), default=0.0) - 10.0)
        if self.kind == BPE:
            self._compile_merges(arcs)
            arcs = [i for i in arcs if self.reachable[i]]
        self.alphabet = {c: k + 1 for k, c in enumerate(sorted({c for i in arcs for c in self.pieces[i]}))}
        # the trie of the piece transducer: transitions as sorted (state, character) keys
        width = self.width = len(self.alphabet) + 1
        states = {"": 0}
        keys, to = [], []
        for i in arcs:
            p = self.pieces[i]
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states)
                    keys.append(states[p[: k - 1]] * width + self.alphabet[p[k - 1]])
                    to.append(states[p[:k]])
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.step = Lookup(np.array(keys, dtype=np.int64)[order], np.array(to, dtype=np.int64)[order], -1)
        self.emits = np.full(len(states), -1, dtype=np.int64)
        for i in arcs:
            self.emits[states[self.pieces[i]]] = i
        self.longest = max((len(self.pieces[i]) for i in arcs), default=1)
        self.cost = np.array([-s for s in self.scores] + [self.unknown_cost])
        # adjacent characters that stand together in some piece; elsewhere an input may be cut
        self.joined = {p[k : k + 2] for i in arcs for p in [self.pieces[i]] for k in range(len(p) - 1)}
        self.memo_parts: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {}
        self.dtype = np.uint16 if n < 65536 else np.uint32
        self.compatible_memo: dict[int, bool] = {}

    def _compile_merges(self, arcs: list[int]) -> None:
        n = len(self.pieces)
        by_score = sorted((i for i in arcs if len(self.pieces[i]) > 1), key=lambda i: -self.scores[i])
        self.rank = np.zeros(n + 1, dtype=np.int64)
        last, rank = None, 0
        for i in by_score:
            rank += self.scores[i] != last
            last = self.scores[i]
            self.rank[i] = rank
        pair: dict[int, int] = {}
        self.left = np.arange(n + 1, dtype=np.int64)
        self.right = np.arange(n + 1, dtype=np.int64)
        self.reachable = np.zeros(n + 1, dtype=bool)
        rank_of = {self.pieces[i]: int(self.rank[i]) for i in arcs}
        for i in arcs:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None and p[:k] in rank_of and p[k:] in rank_of:
                    pair[a * (n + 1) + b] = int(self.rank[i])
            symbols = list(p)
            while len(symbols) > 1:
                best = min(((rank_of.get(symbols[k] + symbols[k + 1], INF), k) for k in range(len(symbols) - 1)))
                if best[0] >= INF:
                    break
                k = best[1]
                if len(symbols) == 2:
                    self.left[i], self.right[i] = self.id_of[symbols[0]], self.id_of[symbols[1]]
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            self.reachable[i] = len(symbols) == 1
        keys = np.array(sorted(pair), dtype=np.int64)
        self.pair_rank = Lookup(keys, np.array([pair[k] for k in keys.tolist()], dtype=np.int64), int(INF))

    # -- the normaliser

    def normalise(self, text: str) -> str:
        """Longest-match rewriting, white space squeezed and a space put first as the model says; spaces become marks."""
        if self.rules:
            out, i = [], 0
            while i < len(text):
                for k in range(min(self.longest_rule, len(text) - i), 0, -1):
                    to = self.rules.get(text[i : i + k])
                    if to is not None:
                        out.append(to)
                        i += k
                        break
                else:
                    out.append(text[i])
                    i += 1
            text = "".join(out)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        text = text.replace(SPACE, " ")
        return " " + text if self.dummy_prefix else text

    # -- the bigram acceptor of merge models

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merge rules leave pieces a[i] and b[i] apart: merges are undone, latest first, looking for one that would have crossed."""
        n1 = len(self.pieces) + 1
        ok = np.ones(len(a), dtype=bool)
        live = np.flatnonzero((a < n1 - 1) & (b < n1 - 1))
        a, b, limit = a[live], b[live], np.full(len(live), INF)
        while len(live):
            crosses = self.pair_rank(a * n1 + b) < limit
            ok[live[crosses]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crosses & ((ra > 0) | (rb > 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_left = ra > rb
            limit = np.where(undo_left, ra, rb + 1)
            a = np.where(undo_left, self.right[a], a)
            b = np.where(undo_left, b, self.left[b])
        return ok

    # -- composition and shortest path

    def paths(self, parts: list[str]) -> list[bytes]:
        """Piece ids on the shortest path of each part, byte fallback done, as little-endian integers."""
        out: list[bytes] = [b""] * len(parts)
        short = [k for k, p in enumerate(parts) if 0 < len(p) <= BATCH_CHARS]
        if short:
            for k, ids in zip(short, self._batch([parts[k] for k in short])):
                out[k] = ids
        for k, p in enumerate(parts):
            if len(p) > BATCH_CHARS:
                out[k] = np.array(self._single(p), dtype=self.dtype).tobytes()
        return out

    def _bytes(self, c: str) -> list[int]:
        if not self.byte_fallback:
            return [self.unk]
        return [self.byte_id[x] for x in c.encode("utf-8", "surrogatepass")]

    def _lattice(self, chars: np.ndarray, lengths: np.ndarray):
        """Arcs (part, start, end, piece) of the composition; a character that no piece begins and ends with gets a fallback arc."""
        L = chars.shape[1]
        part, start = np.nonzero(np.arange(L)[None, :] < lengths[:, None])
        state = np.zeros(len(part), dtype=np.int64)
        at = start.copy()
        found = []
        single = np.zeros(len(part), dtype=bool)
        base = np.arange(len(part))
        for k in range(self.longest):
            state = self.step(state * self.width + chars[part, at])
            go = state >= 0
            part, start, at, base, state = part[go], start[go], at[go], base[go], state[go]
            piece = self.emits[state]
            final = piece >= 0
            found.append((part[final], start[final], at[final] + 1, piece[final]))
            if k == 0:
                single[base[final]] = True
            at = at + 1
            go = at < lengths[part]
            part, start, at, base, state = part[go], start[go], at[go], base[go], state[go]
            if not len(part):
                break
        part, start = np.nonzero(np.arange(L)[None, :] < lengths[:, None])
        lone = ~single
        found.append((part[lone], start[lone], start[lone] + 1, np.full(int(lone.sum()), len(self.pieces))))
        return [np.concatenate(x) for x in zip(*found)]

    def _batch(self, parts: list[str]) -> list[bytes]:
        lengths = np.array([len(p) for p in parts])
        L = int(lengths.max())
        points = np.frombuffer("".join(p.ljust(L, "\0") for p in parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(parts), L)
        values, inverse = np.unique(points, return_inverse=True)
        ids = np.array([self.alphabet.get(chr(v), 0) for v in values.tolist()], dtype=np.int64)
        chars = ids[inverse].reshape(points.shape)
        part, start, end, piece = self._lattice(chars, lengths)
        order = np.lexsort((start, end))
        part, start, end, piece = part[order], start[order], end[order], piece[order]
        bounds = np.searchsorted(end, np.arange(1, L + 2))
        unk = len(self.pieces)
        last = np.full((len(parts), L + 1), -1, dtype=np.int64)
        back = np.zeros((len(parts), L + 1), dtype=np.int64)
        last[:, 0] = unk  # the start state is compatible with all
        cost = np.zeros((len(parts), L + 1)) if self.kind == UNIGRAM else None
        for e in range(1, L + 1):
            lo, hi = bounds[e - 1], bounds[e]
            if lo == hi:
                continue
            p, s, q = part[lo:hi], start[lo:hi], piece[lo:hi]
            if cost is None:
                prev = last[p, s]
                good = prev >= 0
                good[good] = self.compatible(prev[good], q[good])
                p, s, q = p[good], s[good], q[good]
            else:
                total = cost[p, s] + self.cost[q]
                order = np.lexsort((s, total, p))
                p, s, q, total = p[order], s[order], q[order], total[order]
                first = np.r_[True, p[1:] != p[:-1]]
                p, s, q, total = p[first], s[first], q[first], total[first]
                cost[p, e] = total
            last[p, e] = q
            back[p, e] = s
        # all paths are followed back at once; one with a fallback arc is spelled out alone
        rows, at, steps, strange = np.arange(len(parts)), lengths.copy(), [], np.zeros(len(parts), dtype=bool)
        while len(rows):
            q = last[rows, at]
            strange[rows[q == unk]] = True
            steps.append((rows, q))
            at = back[rows, at]
            go = at > 0
            rows, at = rows[go], at[go]
        count = np.bincount(np.concatenate([r for r, _ in steps]), minlength=len(parts))
        ends = np.cumsum(count)
        flat = np.empty(int(ends[-1]), dtype=self.dtype)
        for k, (r, q) in enumerate(steps):
            flat[ends[r] - 1 - k] = np.where(q == unk, 0, q)
        raw, width = flat.tobytes(), self.dtype().itemsize
        bounds = (ends * width).tolist()
        out = [raw[i:j] for i, j in zip([0, *bounds], bounds)]
        for k in np.flatnonzero(strange).tolist():
            n, path = int(lengths[k]), []
            while n:
                q, m = int(last[k, n]), int(back[k, n])
                path.append(self._bytes(parts[k][m]) if q == unk else (q,))
                n = m
            out[k] = np.array([i for ids in reversed(path) for i in ids], dtype=self.dtype).tobytes()
        return out

    def _ok(self, a: int, b: int) -> bool:
        """compatible() for one pair, kept in a memo."""
        n = len(self.pieces)
        if a == n or b == n:
            return True
        key = a * (n + 1) + b
        known = self.compatible_memo.get(key)
        if known is None:
            if len(self.compatible_memo) > MEMO:
                self.compatible_memo.clear()
            known = self.compatible_memo[key] = bool(self.compatible(np.array([a]), np.array([b]))[0])
        return known

    def _single(self, text: str) -> list[int]:
        """The same shortest path for one long part."""
        n, unk = len(text), len(self.pieces)
        last, back, cost = [-1] * (n + 1), [0] * (n + 1), [float("inf")] * (n + 1)
        last[0], cost[0] = unk, 0.0
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                q = self.id_of.get(text[s:e], -1)
                if q >= 0 and self.kind == BPE and not self.reachable[q] or e - s > 1 and q in self.run_pieces:
                    q = -1
                if q < 0:
                    if e - s > 1 or text[s:e] in self.id_of:
                        continue
                    q = unk
                if self.kind == BPE:
                    if last[s] >= 0 and self._ok(last[s], q):
                        last[e], back[e] = q, s
                        break
                elif cost[s] + self.cost[q] < cost[e]:
                    last[e], back[e], cost[e] = q, s, cost[s] + self.cost[q]
        path = []
        while n:
            path.append(self._bytes(text[back[n]]) if last[n] == unk else [last[n]])
            n = back[n]
        return [i for ids in reversed(path) for i in ids]

    # -- words, memo, documents

    def _run(self, k: int) -> list[int]:
        """k space marks: equal weights, so the leftmost pair that makes a piece goes first."""
        out: list[int] = []
        while k or len(out) > 1 and out[-2] + out[-1] in self.runs:
            if len(out) > 1 and out[-2] + out[-1] in self.runs:
                out[-2:] = [out[-2] + out[-1]]
            elif out and out[-1] + 1 in self.runs:
                out[-1] += 1
                k -= 1
            else:
                out.append(1)
                k -= 1
        return [self.runs[n] for n in out]

    def _cut_all(self, word: str) -> list[str]:
        out, at, joined = [], 0, self.joined
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in joined:
                out.append(word[at:k])
                at = k
        out.append(word[at:])
        return out

    def _parts(self, bare: str) -> tuple[str, list[str]]:
        """A word after its mark, cut where no piece reaches over: its first part without the mark, which is a word of its own, and the others."""
        first, *others = self._cut_all(SPACE + bare)
        return first[1:], others

    def learn(self, words: set[str]) -> None:
        """Puts words into the memo. A word is what stands between two spaces, and stands for itself after one mark; leading marks in it are further spaces."""
        known, memo, joined = self.memo_parts, self.memo, self.joined
        whole = {w for w in words if w.isalpha() and len(w) < BATCH_CHARS}
        cut: list[tuple[str, str, list[str]]] = []
        marked: list[tuple[str, int, str]] = []
        new: set[str] = set()
        for w in words.difference(whole):
            body = w[:-1]
            if body.isalpha() and len(w) < BATCH_CHARS and w[-2:] not in joined:
                first, others = body, [w[-1]]
            elif w and w[0] != SPACE:
                first, others = self._parts(w)
            else:
                bare = w.lstrip(SPACE)
                marked.append((w, len(w) - len(bare), bare))
                if not bare or bare in memo:
                    continue
                w = bare
                first, others = self._parts(bare)
            if first != w or others:
                cut.append((w, first, others))
            if first not in memo:
                whole.add(first)
            new.update(others)
        # a part that stands alone keeps its own memo, as it has no mark
        for store, todo, mark in ((memo, sorted(whole.difference(memo), key=len), SPACE), (known, sorted(new.difference(known), key=len), "")):
            at = 0
            while at < len(todo):
                some = todo[at : at + max(1, CHARS // (len(todo[at]) + 1))]
                store.update(zip(some, self.paths([mark + w for w in some] if mark else some)))
                at += len(some)
        for w, first, others in cut:
            memo[w] = memo[first] + (known[others[0]] if len(others) == 1 else b"".join([known[p] for p in others]))
        for w, extra, bare in marked:
            body = memo[bare] if bare else b""
            if not bare:
                ids = self._run(extra + 1)
            elif int(np.frombuffer(body[: self.dtype().itemsize], dtype=self.dtype)[0]) == self.runs[1]:
                ids, body = self._run(extra + 1), body[self.dtype().itemsize :]
            else:
                ids = self._run(extra)
            memo[w] = np.array(ids, dtype=self.dtype).tobytes() + body

    def words(self, text: str) -> tuple[list[str], bool]:
        """The words of a text, and whether its first one has no mark before it."""
        text = self.normalise(text) if self.rules or self.squeeze or SPACE in text else " " + text if text and self.dummy_prefix else text
        if not text:
            return [], False
        if self.kind == UNIGRAM:  # pieces may cross words there: the whole text is one input
            return [text.replace(" ", SPACE)], True
        bare = text[0] != " "
        if not bare:
            text = text[1:]
        if "  " not in text and (not text or text[0] != " "):
            return text.split(" "), bare
        marked = (SPACE if not bare else "") + text.replace(" ", SPACE)
        return [x[1:] if x[0] == SPACE else x for x in re.findall(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+", marked)], bare

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of each text as little-endian unsigned integers (self.dtype); None for None."""
        if len(self.memo) > MEMO or len(self.memo_parts) > MEMO:
            self.memo.clear()
            self.memo_parts.clear()
        split = [None if t is None else self.words(t) for t in texts]
        if self.kind == UNIGRAM:
            return [None if s is None else b"" if not s[0] else self.paths([s[0][0]])[0] for s in split]
        new: set[str] = set()
        for s in split:
            if s is not None:
                new.update(s[0][s[1] :])
        self.learn(new.difference(self.memo))
        memo = self.memo
        out: list[bytes | None] = []
        for s in split:
            if s is None:
                out.append(None)
                continue
            ws, bare = s
            head = b""
            if bare and ws:
                head = b"".join(self.paths(self._cut_all(ws[0])))
                ws = ws[1:]
            out.append(head + b"".join([memo[w] for w in ws]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The inverse: pieces' outputs joined, marks as spaces, the dummy prefix taken off; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_all(np.asarray(ids), np.array([len(ids)]))[0]

    def decode_all(self, flat: np.ndarray, lengths: np.ndarray) -> list[str]:
        """:meth:`decode` of consecutive runs of ids: outputs are copied from one flat table of bytes, some DECODE ids at a time."""
        out: list[str] = []
        ends = np.cumsum(lengths)
        row = at = 0
        while row < len(lengths):
            to = max(row + 1, int(np.searchsorted(ends, at + DECODE, side="right")))
            ids = flat[at : int(ends[to - 1])]
            size = self.out_size[ids]
            upto = np.concatenate([[0], np.cumsum(size)])
            raw = self.out_bytes[np.repeat(self.out_start[ids] - upto[:-1], size) + np.arange(int(upto[-1]))].tobytes()
            stops = upto[ends[row:to] - at].tolist()
            for a, b in zip([0, *stops], stops):
                if self.dummy_prefix and a < b and raw[a] == 32:
                    a += 1
                out.append(raw[a:b].decode("utf-8", "replace"))
            row, at = to, int(ends[to - 1])
        return out


@lru_cache(maxsize=4)
def machine(path: str) -> Machine:
    with open(path, "rb") as f:
        return Machine(f.read())
