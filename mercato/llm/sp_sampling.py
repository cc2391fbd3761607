"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's segmentations into pieces form a lattice; no piece reaches over the
start of a run of blanks, so the lattice is a chain of small ones, one per
token.  Piece scores give every segmentation a probability (``Pieces``).
Backward sums over the lattice turn them into the chance of each edge at its
node.

The k segmentations with the largest Gumbel-perturbed log probabilities are a
sample without replacement.  They are found by A-star search on a tree of
lattice prefixes whose nodes are bounded by their exact maximum: the root's
maximum is Gumbel(0); walking down, the edge drawn at a node inherits the
maximum, and all other edges of the node together are a new open node whose maximum is a
Gumbel of their mass truncated below it.  Popping the best open node draws
one of its edges and walks on to the end of the text, so each pop emits one
segmentation, all distinct, in order.  The best node left open is the
threshold that gives each emitted one its inclusion probability
``1 - exp(-exp(log p - threshold))``.

Noise is a hash of (row key, path, token, place), so a row gives the same sample
wherever and however often it is computed.  Rows are worked on in groups of about
``GROUP`` characters; distinct tokens of a group share one lattice.

Defined results: null and empty texts give one sample without pieces.  A text with
fewer than k segmentations gives all it has.  Characters outside the
vocabulary become their UTF-8 bytes, the blank symbol U+2581 itself too, so
decoding returns every text exactly.  Rows with equal keys and texts get equal
samples; a null key counts as 0.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from mercato.llm.common import BASE, batches, mix, powers, small_batches, table, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
GROUP = 1 << 17
KEPT = 1 << 15
SPREAD = 41.0  # more than the Gumbels of noise from 2**-54 to 1 - 2**-53 lie apart
BLANK = "▁"
_U = np.uint64
_TOKEN = re.compile(" *[^ ]+| +")
_ODD = mix(np.arange(11, 19, dtype=_U)) | _U(1)


class Pieces:
    """The vocabulary of a model file: hashes of its pieces, log weights, bytes.

    A BPE model ranks its pieces but holds no probabilities; a piece of rank r weighs
    1 / (r + 10) (Zipf's law).  Byte pieces weigh as the last rank.
    """

    def __init__(self, model_file: str = MODEL):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        texts, ids, ranks, self.byte_ids = [], [], [], np.zeros(256, dtype=np.int32)
        self.bytes_of: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                if BLANK in piece.lstrip(BLANK):
                    raise ValueError("a piece reaches over a blank; tokens would not be independent")
                texts.append(piece)
                ids.append(i)
                ranks.append(max(0.0, -sp.get_score(i)))
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
        logs = -np.log(np.array(ranks) + 10.0)
        self.byte_log = float(-np.log(len(ranks) + 10.0))
        self.longest = max(map(len, texts))
        hashes = _hash_all(texts)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.logs = hashes[order], np.array(ids, dtype=np.int32)[order], logs[order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.chars, self.base, self.owner, self.place = _trie(dict(zip(texts, place.tolist())))
        self._index()

    def _index(self) -> None:
        """Classes of all characters."""
        self.classes = np.zeros(0x110000, dtype=np.int32)  # 0: in no piece
        self.classes[self.chars] = np.arange(1, len(self.chars) + 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the sorted hashes, -1 where no piece has it."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    _PLAIN = ("byte_ids", "bytes_of", "byte_log", "longest", "hashes", "ids", "logs", "chars", "base", "owner", "place")

    def plain(self) -> dict:
        """The vocabulary as arrays and lists, which any process can read without this class."""
        return {k: getattr(self, k) for k in self._PLAIN}

    @classmethod
    def of(cls, plain: dict) -> "Pieces":
        self = cls.__new__(cls)
        for k in cls._PLAIN:
            setattr(self, k, plain[k])
        self._index()
        return self


def _trie(places: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The beginnings of all pieces as slots of one table (a double array): chars, base, owner, place.

    The i-th char is of class i + 1.  From slot s (0: the empty beginning) a char of class c leads to slot
    ``base[s] + c`` if that slot's owner is s.  ``place`` is the value of a whole piece, else -1.
    """
    often = Counter("".join(places))
    chars = sorted(often, key=lambda c: (-often[c], c))  # frequent classes are small, so children lie close
    number = {c: i for i, c in enumerate(chars, 1)}
    children: dict[str, list[int]] = {}
    for t in sorted({t[:k] for t in places for k in range(1, len(t) + 1)}):
        children.setdefault(t[:-1], []).append(number[t[-1]])
    base, owner, place, full = [0], [-1], [-1], bytearray(b"\1")
    todo = [(-len(children.get("", ())), "", 0)]
    while todo:  # most children first, while the table is empty
        _, t, slot = heapq.heappop(todo)
        mine = sorted(children.get(t, ()))
        if not mine:
            break
        at, i = max(len(full) - mine[0], 1), mine[0]  # behind all others, unless one of the first empty slots fits
        for _ in range(64):
            i = full.find(0, i + 1)
            if i < 0:
                break
            if not any(full[i - mine[0] + c:i - mine[0] + c + 1] == b"\1" for c in mine):
                at = i - mine[0]
                break
        base[slot] = at
        more = max(at + mine[-1] + 1 - len(full), 0)
        full.extend(bytes(more))
        for column, empty in ((base, 0), (owner, -1), (place, -1)):
            column.extend([empty] * more)
        for c in mine:
            child = t + chars[c - 1]
            owner[at + c], place[at + c], full[at + c] = slot, places.get(child, -1), 1
            if child in children:
                heapq.heappush(todo, (-len(children[child]), child, at + c))
    room = [0] * (len(chars) + 1)  # any class may be asked for at any slot
    return (np.array([ord(c) for c in chars], dtype=np.int64), *(np.array(column + more, dtype=np.int32)
            for column, more in ((base, room), (owner, [-1] * len(room)), (place, [-1] * len(room)))))


def _codes(text: str) -> np.ndarray:
    return mix(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(_U) * _U(BASE) + _U(77))


def _hash_all(texts: list[str]) -> np.ndarray:
    code = _codes("".join(texts))
    ends = np.cumsum([len(t) for t in texts])
    return _spans(_sums(code), ends - np.array([len(t) for t in texts]), ends)


def _sums(code: np.ndarray) -> np.ndarray:
    c = np.zeros(len(code) + 1, dtype=_U)
    np.cumsum(code * powers(len(code) + 1)[0][:len(code)], out=c[1:])
    return c


def _spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    # the codes are mixed already, so their polynomial needs no finaliser
    return (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]


def _stable_order(x: np.ndarray) -> np.ndarray:
    """A stable argsort of whole numbers from 0, by 16 bits at a time (which numpy sorts in linear time)."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while len(x) and int(x.max()) >> shift:
        order = order[np.argsort(((x[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


class Lattice:
    """Edges of the lattices of distinct tokens, grouped by start node, with each edge's chance at its node.

    Nodes are character positions, with one more behind each token; edges stand in the order of how much of the token
    is left at their node, longer pieces first.  ``begin`` of a node is its first edge times 2, plus 1 if it has
    others, and -1 behind a token; ``next`` of an edge is the node it leads to.
    """

    def __init__(self, tokens: list[str], v: Pieces):
        """Tokens are given without their first blank."""
        # a blank is written as BLANK in pieces; BLANK itself must not match them
        whole = "".join((" ", "\0 ".join(tokens), "\0")) if tokens else ""
        text = whole.replace(BLANK, "\ufdd0").replace(" ", BLANK)
        size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 2
        self.start = np.cumsum(size) - size
        n = int(size.sum())
        behind = self.start + size - 1
        rest = np.repeat(behind, size) - np.arange(n)
        by_rest = _stable_order(rest)
        rank = np.empty(n, dtype=np.int64)
        rank[by_rest] = np.arange(n)
        code = v.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        code[behind] = 0  # no piece reaches over it
        slot = v.base[0] + code
        i = np.flatnonzero(v.owner[slot] == 0)
        slot = slot[i]
        found = []  # by piece length: ranks of start nodes, pieces, next nodes
        known = np.zeros(n, dtype=bool)
        known[behind] = True
        for k in range(1, v.longest + 1):
            p = v.place[slot]
            hit = np.flatnonzero(p >= 0)
            at = i[hit]
            found.append((rank[at], p[hit], at + k))
            if k == 1:
                known[at] = True
            longer = v.base[slot] + code[k:][i]
            on = np.flatnonzero(v.owner[longer] == slot)
            if not len(on):
                break
            i, slot = i[on], longer[on]
        lost = np.flatnonzero(~known)  # characters without a piece: their UTF-8 bytes, one edge
        raw = [whole[i].encode("utf-8", "surrogatepass") for i in lost.tolist()]
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_size = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        spelt = -1 - np.arange(len(lost))
        single = self.raw_size == 1  # one byte is one piece
        spelt[single] = v.byte_ids[self.raw[self.raw_at[single]]]
        found.insert(0, (rank[lost], len(v.ids) + np.arange(len(lost)), lost + 1))

        fan = np.bincount(np.concatenate([r for r, _, _ in found]), minlength=n)  # a node has one edge of a length at most
        self.ptr = np.concatenate(([0], np.cumsum(fan)))
        edges = int(self.ptr[-1])
        place, self.next = np.empty(edges, dtype=np.int64), np.empty(edges, dtype=np.int64)
        free = self.ptr[:-1].copy()
        for r, p, to_node in reversed(found):  # longer, likelier pieces first
            to = free[r]
            free[r] = to + 1
            place[to], self.next[to] = p, to_node
        self.begin = (self.ptr[:-1] * 2 + (fan > 1))[rank]
        self.begin[behind] = -1
        self.piece = np.concatenate((v.ids, spelt.astype(np.int32)))[place]
        log = np.concatenate((v.logs, self.raw_size * v.byte_log))[place]
        beta = np.zeros(n)
        self.upto = np.zeros(edges)
        level = np.cumsum(np.bincount(rest)) if n else np.zeros(1, dtype=np.int64)
        self.log = np.zeros(edges)
        for d in range(1, len(level)):
            p0, p1 = level[d - 1], level[d]
            if p0 == p1:
                continue
            e0, e1 = self.ptr[p0], self.ptr[p1]
            value = log[e0:e1] + beta[self.next[e0:e1]]
            first = self.ptr[p0:p1] - e0
            top = np.maximum.reduceat(value, first)
            weight = np.exp(value - np.repeat(top, fan[p0:p1]))
            total = np.add.reduceat(weight, first)
            here = top + np.log(total)
            beta[by_rest[p0:p1]] = here
            self.log[e0:e1] = value - np.repeat(here, fan[p0:p1])
            self.upto[e0:e1] = weight / np.repeat(total, fan[p0:p1])
        np.minimum(self.log, 0.0, out=self.log)
        # running share of a node's edges, node by node, so that it does not depend on other tokens
        nodes, turn = np.flatnonzero(fan > 1), 1
        while len(nodes):
            e = self.ptr[nodes] + turn
            self.upto[e] += self.upto[e - 1]
            turn += 1
            nodes = nodes[fan[nodes] > turn]
        self.upto[self.ptr[len(tokens) + 1:] - 1] = 1.0

    def draw(self, e: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each first edge of a node the edge whose share of the node holds u."""
        left = np.flatnonzero(self.upto[e] < u)
        while len(left):
            e[left] += 1
            left = left[self.upto[e[left]] < u[left]]
        return e

    def with_bytes(self, ids: np.ndarray, v: Pieces) -> np.ndarray:
        """Piece ids with each lost character of several bytes (a negative number) spelt as byte pieces."""
        lost = np.flatnonzero(ids < 0)
        if not len(lost):
            return ids
        which = -1 - ids[lost]
        size = np.ones(len(ids), dtype=np.int64)
        size[lost] = self.raw_size[which]
        at = np.cumsum(size) - size
        out = np.repeat(ids, size)
        k = self.raw_size[which]
        inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        out[np.repeat(at[lost], k) + inside] = v.byte_ids[self.raw[np.repeat(self.raw_at[which], k) + inside]]
        return out


def _numbers(kept: dict[str, int]) -> defaultdict:
    """The kept numbers, then new keys numbered in order."""
    return defaultdict(count(len(kept)).__next__, kept)


def _seed(key: np.ndarray, *parts, at: int = 0) -> np.ndarray:
    """The key plus the parts, each times its own odd number from place ``at`` on."""
    x = key.copy()
    for i, p in enumerate(parts):
        x += np.asarray(p).astype(np.int64).view(_U) * _ODD[at + i]
    return x


def _noise(seed: np.ndarray) -> np.ndarray:
    """Uniform noise in (0, 1), a hash of the seed."""
    u = (mix(seed) >> _U(11)).astype(np.float64)
    u += 0.5
    u *= 2.0 ** -53
    return u


def _uniform(key: np.ndarray, *parts) -> np.ndarray:
    return _noise(_seed(key, *parts))


def _truncated(place: np.ndarray, below: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel at ``place`` given that it is less than ``below``."""
    return place - np.log(np.exp(np.minimum(place - below, 700.0)) - np.log(u))


class _Path:
    """Decisions of one walk for many rows: per row a slice of edges, and its ``k`` best open nodes beside them."""

    def __init__(self, lat: Lattice, key, path: int, row, ordinal, node, phi0, top, rows: int, k: int):
        """Walks from ``node`` (first place in a token) for every (row, ordinal); arrays are in row, token order."""
        self.ordinal = ordinal
        seed = token_seed = _seed(key[row], path, ordinal)
        edges, owner, turn = [], [], 0
        active, now, begin = np.arange(len(node)), node, lat.begin[node]
        steps = np.zeros(len(node), dtype=np.int64)
        while len(active):
            e = begin >> 1
            many = np.flatnonzero(begin & 1)  # a node with one edge needs no draw
            e[many] = lat.draw(e[many], _noise(seed[many]))
            edges.append(e)
            owner.append(active)
            turn += 1
            steps[active] = turn
            to = lat.next[e]
            begin = lat.begin[to]
            go = np.flatnonzero(begin >= 0)
            to = to[go]
            # a decision's seed holds its place in the token
            active, seed, now, begin = active[go], _seed(seed[go], to - now[go], at=2), to, begin[go]
        self.begin = np.cumsum(steps) - steps  # a token's decisions stand together, in the order of its steps
        self.edge = np.empty(int(steps.sum()), dtype=np.int64)
        for t, (who, e) in enumerate(zip(owner, edges)):
            self.edge[self.begin[who] + t] = e
        self.first = np.append(self.begin, len(self.edge))[np.searchsorted(row, np.arange(rows + 1))]
        gain = lat.log[self.edge]
        self.run = np.concatenate(([0.0], np.cumsum(gain)))
        self.shift = self.run[self.first[:-1]] - phi0
        self.end_phi = self.run[self.first[1:]] - self.run[self.first[:-1]] + phi0
        self._open(gain, token_seed, top, k)

    def before(self, i, row):
        """Log probability of the path up to decision i of a row."""
        return self.run[i] - self.shift[row]

    def token(self, i):
        """Number of the walk's token that decision i belongs to."""
        return np.searchsorted(self.begin, i, side="right") - 1

    def _open(self, gain: np.ndarray, seed: np.ndarray, top: np.ndarray, k: int) -> None:
        """``best``: per row its k best open nodes, (bound, decision).

        Nodes of a row rank as their Gumbels do before these are truncated, all below one maximum.  Noise moves a Gumbel
        by less than ``SPREAD``, and the path's log probability only falls: past the point where it is further than that
        below the places of k earlier nodes, no node can be among the best, and none is drawn.
        """
        free = np.flatnonzero(gain < -1e-12)  # the others leave nothing open beside them
        edge = np.searchsorted(free, self.first)  # of each row's slice in free
        size = np.diff(edge)
        least = np.full(len(size), np.inf)
        for j in range(min(k, int(size.max(initial=0)))):
            has = np.flatnonzero(size > j)
            i = free[edge[has] + j]
            least[has] = np.minimum(least[has], self.before(i, has) + np.log1p(-np.exp(gain[i])))
        least[size < k] = -np.inf
        near = np.flatnonzero(self.run[free] >= np.repeat(least - SPREAD + self.shift, size))
        row = np.searchsorted(edge, near, side="right") - 1
        free = free[near]
        place = self.before(free, row) + np.log1p(-np.exp(gain[free]))
        token = self.token(free)
        u = _noise(_seed(seed[token], free - self.begin[token], 1, at=2))
        bound = _truncated(place, top[row], np.minimum(u, 1 - 2.0 ** -53))
        self.best: list[list[tuple[float, int]]] = [[] for _ in size]
        have, first = np.unique(row, return_index=True)
        size = np.diff(np.append(first, len(row)))
        for _ in range(k if len(have) else 0):
            most = np.maximum.reduceat(bound, first)
            at = np.flatnonzero((bound == np.repeat(most, size)) & (bound > -np.inf))
            at = at[np.unique(row[at], return_index=True)[1]]
            for r, b, i in zip(row[at].tolist(), bound[at].tolist(), free[at].tolist()):
                self.best[r].append((b, i))
            bound[at] = -np.inf


class Lattices:
    """The lattices of a task's groups: tokens of its first groups stay, others are built for their group alone.

    About ``KEPT`` tokens stay, mostly the frequent ones.  A group's own lattice is written behind the kept one, into
    arrays with room to grow, so what is kept is neither built nor copied again.
    """

    _ARRAYS = ("start", "begin", "ptr", "piece", "next", "log", "upto", "raw", "raw_size", "raw_at")

    def __init__(self, v: Pieces):
        self.v, self.kept = v, {}
        self.room: dict[str, np.ndarray] = {}
        self.sizes = dict.fromkeys(self._ARRAYS, 0) | {"ptr": 1}  # ptr begins with a 0

    def of(self, found: dict[str, int]) -> Lattice:
        """The lattice of the tokens of ``found`` (keys without their first blank), which begin with the kept ones."""
        new = Lattice(list(islice(found, len(self.kept), None)), self.v)
        nodes, edges, lost, raw = (self.sizes[name] for name in ("begin", "piece", "raw_size", "raw"))
        new.start += nodes
        new.begin[new.begin >= 0] += 2 * edges
        new.next += nodes
        new.ptr = new.ptr[1:] + edges
        new.piece[new.piece < 0] -= lost
        new.raw_at += raw
        out, sizes = Lattice.__new__(Lattice), {}
        for name in self._ARRAYS:
            added, at = getattr(new, name), self.sizes[name]
            end = sizes[name] = at + len(added)
            if name not in self.room or len(self.room[name]) < end:
                grown = np.zeros(end * 5 // 4 + 16, dtype=added.dtype)
                if name in self.room:
                    grown[:at] = self.room[name][:at]
                self.room[name] = grown
            self.room[name][at:end] = added
            setattr(out, name, self.room[name][:end])
        if len(self.kept) < KEPT:
            self.kept, self.sizes = dict(found), sizes
        return out


def _keys(text: str) -> list[str]:
    """The tokens of a text behind a blank, each without its first blank."""
    if text[0] != " " and "  " not in text:
        return text.split(" ")
    return [t[1:] for t in _TOKEN.findall(" " + text)]


def sample_group(texts: list[str], keys: list[int], v: Pieces, k: int,
                 lattices: Lattices | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to k segmentations (piece ids, log probability, perturbed value, inclusion probability), best first.

    ``lattices`` carries what the groups of a task share; it changes no result.
    """
    lattices = lattices or Lattices(v)
    rows, found = len(texts), _numbers(lattices.kept)
    tokens = [_keys(t) if t else [] for t in texts]
    size = np.array([len(x) for x in tokens], dtype=np.int64)
    flat = np.fromiter(map(found.__getitem__, chain.from_iterable(tokens)), dtype=np.int64, count=int(size.sum()))
    lat = lattices.of(found)
    key = mix(np.array(keys, dtype=np.int64).view(_U) + _U(0xC0FFEE))
    row = np.repeat(np.arange(rows), size)
    first = np.cumsum(size) - size
    ordinal = np.arange(len(flat)) - np.repeat(first, size)
    root = -np.log(-np.log(_uniform(key, 0)))
    paths = [_Path(lat, key, 0, row, ordinal, lat.start[flat], np.zeros(rows), root, rows, k)]
    # a path is (parent, decisions kept from it, drawn edge or None): (number in paths, upto, edge)
    done = [[((None, 0, None, 0), float(root[r]), float(paths[0].end_phi[r]))] for r in range(rows)]
    heaps: list[list] = [[(-b, 0, i, ()) for b, i in x] for x in paths[0].best]
    for h in heaps:
        heapq.heapify(h)
    lineage = [[(None, 0, None, 0)] for _ in range(rows)]
    for turn in range(1, k):
        start_row, start_ordinal, start_node, phi, top = [], [], [], np.zeros(rows), np.zeros(rows)
        grown: dict[int, tuple] = {}
        popped = [(r, *heapq.heappop(h)) for r, h in enumerate(heaps) if h]
        at, barred = [x[3] for x in popped], [len(x[4]) or 1 for x in popped]
        seed = _seed(key[np.array([x[0] for x in popped], dtype=np.int64)], turn, at, barred)
        which, stay = (_noise(_seed(seed, x, at=3)).tolist() for x in (2, 3))
        for (r, value, p, i, barred), u, u_stay in zip(popped, which, stay):
            value, path = -value, paths[p]
            taken = path.edge[i]
            node = int(np.searchsorted(lat.ptr, taken, side="right") - 1)
            barred = barred or (int(taken),)
            options = [e for e in range(lat.ptr[node], lat.ptr[node + 1]) if e not in barred]
            w = np.exp(lat.log[options])
            e = options[min(int(np.searchsorted(np.cumsum(w) / w.sum(), u)), len(options) - 1)]
            rest = w.sum() - np.exp(lat.log[e])
            if len(options) > 1 and rest > 1e-15:
                b = _truncated(path.before(i, r) + np.log(rest), value, u_stay)
                heapq.heappush(heaps[r], (-float(b), p, i, barred + (e,)))
            grown[r] = (p, i - int(path.first[r]), e)
            phi[r], top[r] = path.before(i, r) + lat.log[e], value
            t = int(path.ordinal[path.token(i)])
            if lat.begin[lat.next[e]] >= 0:
                start_row.append([r])
                start_ordinal.append([t])
                start_node.append([lat.next[e]])
            later = np.arange(t + 1, size[r])
            start_row.append(np.full(len(later), r))
            start_ordinal.append(later)
            start_node.append(lat.start[flat[first[r] + later]])
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        # later pops, then the threshold
        walk = _Path(lat, key, turn, join(start_row), join(start_ordinal), join(start_node), phi, top, rows, k - turn)
        paths.append(walk)
        for r, found_open in enumerate(walk.best):
            if r in grown:
                done[r].append(((*grown[r], len(paths) - 1), float(top[r]), float(walk.end_phi[r])))
                for b, i in found_open:
                    heapq.heappush(heaps[r], (-b, len(paths) - 1, i, ()))

    def decisions(r: int, origin) -> np.ndarray:
        parent, kept, e, number = origin
        own = paths[number].edge[paths[number].first[r]:paths[number].first[r + 1]]
        if parent is None:
            return own
        whole = decisions(r, by_number[r][parent])
        return np.concatenate((whole[:_depth(r, parent) + kept], [e], own))

    def _depth(r: int, number: int) -> int:
        """Decisions that a path keeps from its ancestors before its own."""
        parent, kept, _, _ = by_number[r][number]
        return 0 if parent is None else _depth(r, parent) + kept + 1

    by_number = [{o[0][3]: o[0] for o in x} for x in done]
    chosen = [decisions(r, x[0]) for r in range(rows) for x in done[r]]
    ends = np.cumsum([len(x) for x in chosen]).tolist()
    pieces = lat.piece[np.concatenate(chosen)] if chosen else np.zeros(0, np.int32)
    every = (pieces[a:b] for a, b in zip([0, *ends], ends))
    if len(pieces) and pieces.min() < 0:
        every = (lat.with_bytes(ids, v).astype(np.int32) for ids in every)
    out = []
    for r in range(rows):
        threshold = -heaps[r][0][0] if heaps[r] else -math.inf
        mine = []
        for _, value, phi_ in done[r]:
            inclusion = 1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(phi_ - threshold, 50.0)))
            mine.append((next(every), min(0.0, phi_), value, inclusion))
        out.append(mine)
    return out


def decoded(ids, v: Pieces) -> str:
    """The text of a piece sequence."""
    data = b"".join(map(v.bytes_of.__getitem__, ids))
    return data[1:].decode("utf-8", "surrogatepass") if data[:1] == b" " else data.decode("utf-8", "surrogatepass")


def _groups(sizes: list[int | None]) -> Iterator[tuple[int, int]]:
    """Runs (first row, rows) of at most about ``GROUP`` characters, or one longer text."""
    at, size = 0, 0
    for i, n in enumerate(sizes):
        if i > at and size + (n or 0) > GROUP:
            yield at, i - at
            at, size = i, 0
        size += n or 0
    if len(sizes) > at:
        yield at, len(sizes) - at


SAMPLE_TYPE = "array<struct<ids:array<int>,log_prob:double,perturbed:double,inclusion:double>>"


def sampled_encodings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES,
                      model_file: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_chars, n_samples and the samples of every row, then its columns ``keep``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model_file).plain())  # one vocabulary, fixed by the model file

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Pieces.of(shared.value)
        lattices = Lattices(v)
        for b in it:
            for at, size in _groups(pc.utf8_length(b.column(1)).to_pylist()):
                texts = [t or "" for t in b.column(1).slice(at, size).to_pylist()]
                rows = sample_group(texts, [i or 0 for i in b.column(0).slice(at, size).to_pylist()], v, k, lattices)
                flat = [s for r in rows for s in r]
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s[0]) for s in flat]))), pa.int32()),
                                               pa.array(np.concatenate([s[0] for s in flat]) if flat else [], pa.int32()))
                parts = pa.StructArray.from_arrays([ids, *(pa.array([s[i] for s in flat], pa.float64()) for i in (1, 2, 3))],
                                                   names=["ids", "log_prob", "perturbed", "inclusion"])
                samples = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))), pa.int32()), parts)
                yield pa.record_batch([b.column(0).slice(at, len(rows)), pa.array([len(t) for t in texts], pa.int64()),
                                       pa.array([len(r) for r in rows], pa.int32()), samples,
                                       *(c.slice(at, len(rows)) for c in b.columns[2:])],
                                      names=["doc_id", "n_chars", "n_samples", "samples", *keep])
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    kept = "".join(f", `{n}` {t}" for n, t in texts.dtypes[2:])
    return texts.mapInArrow(tidy(run), f"doc_id long, n_chars long, n_samples int, samples {SAMPLE_TYPE}{kept}")


def decoded_texts(encoded: DataFrame, ids_col: str = "ids", model_file: str = MODEL) -> DataFrame:
    """Adds ``text``, decoded from the piece ids, to every row."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(model_file).plain())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Pieces.of(shared.value)
        for b in batches(it):
            at = b.schema.get_field_index(ids_col)
            yield b.append_column("text", pa.array([decoded(x or [], v) for x in b.column(at).to_pylist()], pa.string()))
    return encoded.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", text string")


def op5_gumbel_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, without replacement, with inclusion scores."""
    return sampled_encodings(table(spark, sf_dir, "documents"))
