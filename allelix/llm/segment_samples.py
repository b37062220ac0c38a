"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement.

A text's lattice has an edge for every piece of the vocabulary that fits; characters without a piece fall back to
bytes. No piece crosses the cells ``white space + word`` or a line end, so the lattice is a chain of the cells' lattices
(a word of any length is one cell), which are built once for each different cell of a batch (rolling hashes find the pieces, sums from the end give the mass
behind each node; blocks of a long cell go side by side, once for each node that a piece may reach behind the block, then
with the masses that these give). A segmentation's probability is the product of its pieces' weights over the lattice's total.

Samples come by a perturbed A-star search. The whole lattice has a Gumbel value; the best segmentation is drawn by
going along edges with their probabilities. What is left is the set of segmentations that leave this path by another
edge at one of its steps; its Gumbel value is truncated at the parent's. The queue's best set is opened next: a step by
its share of the set's mass, an edge there, and a walk to the end give its best segmentation, and two sets are left, the
old one without that edge and what leaves the new path after it. So k distinct segmentations come out in order of
their perturbed values. Steps whose share of a set's mass is below double precision (e to the -50) end the sum over its steps.
The value of the best set left is the threshold of the inclusion scores
``log(1 - exp(-exp(log_prob - threshold)))``, 0 where nothing is left.

Random numbers are a hash of seed, row id, sample, cell and step, so a row's samples depend on nothing but the row. Texts are
sampled alone in the task that reads them: no shuffle.

Defined results: null and empty texts have one segmentation of no pieces; texts with fewer than k segmentations give
those they have; repeated rows get equal samples, as do rows of null ids with equal texts; an empty table gives an
empty result; other columns are not read. Decoding turns the mark U+2581 into a space, as the library does.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import ids_and_text, mapped, mix

MARK = "▁"
SCHEMA = "doc_id long, sample int, n_tokens long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean"
CELL = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Bytes of text whose lattices, paths and ids a task holds at once; a longer text stands alone.
SLICE_BYTES = 100_000
#: Cells of more characters are summed in blocks of as many, side by side, and every node of them draws its edge at once.
BLOCK = 512
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1B54A32D192ED03)


class Vocabulary:
    """Pieces of a SentencePiece model by length, their log weights and bytes.

    The weight of a piece is its score in a unigram model, else that of its rank by Zipf's law, times alpha.
    """

    held: dict[tuple[str, float], Vocabulary] = {}

    @classmethod
    def at(cls, path: str, alpha: float) -> Vocabulary:
        if (path, alpha) not in cls.held:
            cls.held[path, alpha] = cls(path, alpha)
        return cls.held[path, alpha]

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = np.array([model.get_score(i) for i in range(n)])
        by_rank = not (scores[plain] % 1).any()
        self.weight = np.zeros(n)
        order = sorted(plain, key=lambda i: (-scores[i], i))
        self.weight[order] = -np.log(np.arange(len(order)) + 2.7) if by_rank else scores[order]
        self.byte_weight = alpha * (self.weight[plain].min() - 1.0)
        self.weight *= alpha
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size = n
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.spans = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])])
        if any(re.search(f"[^{MARK}]{MARK}|\n", pieces[i]) for i in plain):
            raise ValueError("the vocabulary has pieces across words")
        self.singles = {pieces[i] for i in plain if len(pieces[i]) == 1}
        self.tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]] = []
        for length in sorted({len(pieces[i]) for i in plain}):
            own = np.array([i for i in plain if len(pieces[i]) == length])
            key = np.zeros(len(own), np.uint64)
            codes = np.array([[ord(c) for c in pieces[i]] for i in own], np.uint64)
            for j in range(length):
                key = key * BASE + mix(codes[:, j])
            order = np.argsort(key * BASE)  # pieces of one slot stand together
            many = np.bincount(key * BASE >> np.uint64(48), minlength=1 << 16)
            some, head = many > 0, np.cumsum(many) - many
            longer = np.array([[ord(c) for c in p] for p in {pieces[i][:length] for i in plain if len(pieces[i]) > length}], np.uint64).reshape(-1, length)
            start = np.zeros(len(longer), np.uint64)
            for j in range(length):
                start = start * BASE + mix(longer[:, j])
            begun = np.zeros(1 << 16, bool)  # beginnings of longer pieces
            begun[start * BASE >> np.uint64(48)] = True
            self.tables.append((length, key[order], own[order], some, begun, head, int(many.max())))
        self.single_codes = np.sort(np.array([ord(c) for c in self.singles]))

    def expand(self, ids: np.ndarray) -> np.ndarray:
        """Ids with fallback characters (size + code point) spelt in bytes."""
        return self.expand_many(ids, np.array([0, len(ids)]))[0]

    def expand_many(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """expand() of the stretches of ids between bounds, and their new bounds."""
        odd = np.flatnonzero(ids >= self.size)
        if not len(odd):
            return ids, bounds
        points, which = np.unique(ids[odd] - self.size, return_inverse=True)
        spelt = [[self.byte_ids.get(b, self.unknown) for b in chr(c).encode("utf-8", "surrogatepass")] for c in points.tolist()]
        flat, width = np.array([i for x in spelt for i in x], ids.dtype), np.array(list(map(len, spelt)))
        size = np.ones(len(ids), np.int64)
        size[odd] = width[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(ids, size)
        within = np.arange(int(size[odd].sum())) - np.repeat(np.cumsum(size[odd]) - size[odd], size[odd])
        out[np.repeat(ends[odd], size[odd]) + within] = flat[np.repeat((np.cumsum(width) - width)[which], size[odd]) + within]
        return out, ends[bounds]

    def decode_many(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """decode() of each stretch of ids between bounds."""
        size = self.spans[ids + 1] - self.spans[ids]
        ends = np.cumsum(size)
        data = self.flat[np.repeat(self.spans[ids] - (ends - size), size) + np.arange(size.sum())].tobytes()
        cuts = np.concatenate([[0], ends])[bounds].tolist()
        return [data[a + 1 : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids, in UTF-8, without the space that stands before every text."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


class Lattices:
    """Lattices of different cells: a node for each character and each cell's end, and at each node a column for each
    length of piece. Arrays stand column by column, so that sums over a node's edges are sums of columns; an edge is
    column * rows + row.
    """

    def __init__(self, cells: list[str], words: Vocabulary):
        sizes = np.fromiter(map(len, cells), np.int64, len(cells))
        self.first = np.cumsum(sizes + 1) - sizes - 1
        n, columns = int(sizes.sum() + len(cells)), len(words.tables)
        code = np.frombuffer("\0".join([*cells, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        left = np.repeat(self.first + sizes, sizes + 1) - np.arange(n)
        self.rows, self.lengths = n, np.array([t[0] for t in words.tables])
        # Rows stand in order of the distance to the cell's or block's end, as they are summed; row[node] is a node's row.
        long = np.flatnonzero(sizes > BLOCK)
        level = np.where((left > 0) & np.repeat(sizes > BLOCK, sizes + 1), (left - 1) % BLOCK + 1, left) if len(long) else left
        order = np.argsort(level.astype(np.int16 if BLOCK < 1 << 15 else np.int64), kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(level))])
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        piece, value, final = np.full((columns, n), -1, np.int32), np.full((columns, n), -np.inf), np.zeros(n, np.int8)
        hashed = mix(code)
        fits = np.flatnonzero(left > 0)
        key, done = np.zeros(len(fits), np.uint64), 0
        for column, (length, keys, own, some, begun, head, most) in enumerate(words.tables):
            enough = np.flatnonzero(left.take(fits) >= length)
            fits, key = fits.take(enough), key.take(enough)
            while done < length:
                key = key * BASE + hashed.take(fits + done)
                done += 1
            slot = (key * BASE >> np.uint64(48)).astype(np.int64)
            maybe = np.flatnonzero(some.take(slot))
            wanted = key.take(maybe)
            place = head.take(slot.take(maybe))
            hit = keys.take(place) == wanted
            for _ in range(1, most):
                rest = np.flatnonzero(~hit)
                place[rest] = np.minimum(place[rest] + 1, len(keys) - 1)
                hit[rest] = keys[place[rest]] == wanted[rest]
            hit = np.flatnonzero(hit)
            at, place = row.take(fits.take(maybe.take(hit))), own.take(place.take(hit))
            piece[column, at] = place
            value[column, at] = words.weight.take(place)
            final[at] = column
            on = np.flatnonzero(begun.take(slot))
            fits, key = fits.take(on), key.take(on)
        inner = bounds[1] + np.flatnonzero(piece[0, bounds[1] :] < 0)  # no piece of this one character
        points = code[order[inner]].astype(np.int64)
        piece[0, inner] = points + words.size
        value[0, inner] = words.byte_weight * (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
        behind = np.zeros(n + int(self.lengths[-1]))
        for cell in long.tolist():
            self._between(self.first[cell] + sizes[cell], int(sizes[cell]), value, row, behind)
        # A node's sums up to each column but its last one, then numbers that no draw passes; eight columns an array.
        self.sums = [np.full((n, 8), 2.0, np.float32) for _ in range(0, columns, 8)]
        for far in range(1, len(bounds) - 1):
            part = slice(bounds[far], bounds[far + 1])
            at = order[part]
            if not len(at):
                continue
            c = columns if len(long) and far <= BLOCK else int(np.searchsorted(self.lengths, far, "right"))  # no longer piece fits
            own = value[:c, part]
            if len(at) < 64:  # far into long cells
                own += behind[at + self.lengths[:c, None]]
            else:
                for k in range(c):
                    own[k] += behind.take(at + self.lengths[k])
            top = own.max(axis=0)
            own -= top
            sums = np.exp(own)
            for k in range(1, c):
                sums[k] += sums[k - 1]
            total = np.log(sums[-1])
            behind[at] = top + total
            own -= total
            sums /= sums[-1].copy()
            sums[np.arange(c, dtype=np.int8)[:, None] >= final[part]] = 2.0
            for k in range(0, c, 8):
                self.sums[k // 8][part, : c - k] = sums[k : k + 8].T
        self.left, self.row, self.node, self.by_column, self.log, self.piece = left, row, order, value, value.ravel(), piece.ravel()
        self.cells_end = bounds[1]  # rows before it are cells' ends

    def _between(self, end: int, size: int, value: np.ndarray, row: np.ndarray, behind: np.ndarray, at_once: int = 256) -> None:
        """Fills in the mass behind the last nodes of each block (seen from the cell's end) but the last one.

        Each block is summed for each of the nodes behind it as if that alone had mass; these sums are then put together
        block by block.
        """
        reach = int(self.lengths[-1])
        edge, blocks = np.full(reach, -np.inf), (size - 1) // BLOCK
        edge[0] = 0.0
        for some in np.array_split(np.arange(blocks), -(-blocks // at_once)):
            near = np.full((len(some), reach, reach), -np.inf)  # block, characters back less one, node behind the block
            near[:, np.arange(reach), np.arange(reach)] = 0.0
            for t in range(1, BLOCK + 1):
                own = value.T[row[end - some * BLOCK - t]][:, :, None] + near[:, self.lengths - 1]
                new = log_sum(own)
                near[:, 1:] = near[:, :-1].copy()
                near[:, 0] = new
            for block, one in zip(some.tolist(), near, strict=True):
                edge = log_sum((one + edge).T[None])[0]
                start = end - (block + 1) * BLOCK
                behind[start : min(start + reach, end)] = edge[: end - start]

    def end(self, edges: np.ndarray) -> np.ndarray:
        """The node that each edge leads to."""
        return self.node[edges % self.rows] + self.lengths[edges // self.rows]

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random edges from each node to its cell's end: the edges in order, and the place of each one's node."""
        who, at = np.arange(len(nodes)), nodes.copy()
        taken, whose, step = [], [], 0
        far = self.left[at] > BLOCK
        for i in np.flatnonzero(far).tolist():
            taken.append(self._far_walk(int(at[i]), seeds[i]))
            whose.append(np.full(len(taken[-1]), i))
        if taken:
            who, at = who[~far], at[~far]
        while True:
            row = self.row.take(at)
            live = np.flatnonzero(row >= self.cells_end)
            if len(live) < len(at):
                who, at, row = who.take(live), at.take(live), row.take(live)
            if not len(at):
                break
            column = self._column(row, uniform(seeds.take(who), step))
            taken.append(column * self.rows + row)
            whose.append(who)
            at = at + self.lengths.take(column)
            step += 1
        if not taken:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        whose = np.concatenate(whose)
        order = np.argsort(whose.astype(np.uint16) if len(nodes) < 1 << 16 else whose, kind="stable")  # short numbers sort in linear time
        return np.concatenate(taken).take(order), whose.take(order)

    def _column(self, row: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The column of each row that its number from 0 to 1 falls on."""
        u = u.astype(np.float32)
        found = self._passed(0, row, u)
        for k in range(1, len(self.sums)):
            on = np.flatnonzero(found == 8 * k)  # few: sums of most nodes end before
            if not len(on):
                break
            found[on] += self._passed(k, row[on], u[on])
        return found

    def _passed(self, k: int, row: np.ndarray, u: np.ndarray) -> np.ndarray:
        """How many of eight sums each number has reached."""
        return np.bitwise_count((self.sums[k].take(row, axis=0) <= u[:, None]).view(np.uint64).ravel()).astype(np.int64)  # eight truths in a word

    def _far_walk(self, start: int, seed: np.uint64, at_once: int = 1 << 16) -> np.ndarray:
        """The edges of a walk from a node far from its cell's end: every node draws an edge, the walk goes along them."""
        stop, columns = start + int(self.left[start]), []
        for a in range(start, stop, at_once):
            b = min(a + at_once, stop)
            columns.append(self._column(self.row[a:b], uniform(seed + self.left[a:b].astype(np.uint64) * STEP, 0)))
        column = np.concatenate(columns)
        hops, at, path = self.lengths[column].tolist(), 0, []
        while at < len(hops):
            path.append(at)
            at += hops[at]
        return column[path] * self.rows + self.row[start + np.array(path)]


def log_sum(x: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over the middle axis, of numbers given by their logarithms."""
    top = np.maximum(x.max(axis=1), -1e300)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def uniform(seeds: np.ndarray, step: int) -> np.ndarray:
    """Numbers from 0 to below 1, by a hash of mixed seeds and a step."""
    x = seeds + np.uint64((step + 1) * int(STEP) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return (x >> np.uint64(11)) * 2.0**-53


def gumbel(where: float, u: float, top: float) -> float:
    """A Gumbel value at where, given that it is at most top."""
    if where == -math.inf:
        return -math.inf
    free = where - math.log(-math.log(min(max(u, 1e-300), 1 - 1e-16)))
    low, high = sorted((-top, -free))
    return -high - math.log1p(math.exp(low - high)) if high > -math.inf else math.inf


def cut(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Cells of all texts: their codes in order, the different cells, and each text's first cell (with the end).

    Texts where spaces meet or start the text are cut one by one.
    """
    n = len(texts)
    slow = pc.match_substring_regex(texts, f"^ |  |{MARK}").to_numpy(zero_copy_only=False) if n else np.empty(0, bool)
    fast = pc.if_else(pa.array(slow), pa.scalar(None, pa.string()), pc.replace_substring(texts, "\n", " \n "))
    lists = pc.split_pattern(pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar(None, pa.string()), fast), " ")
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    line = pc.equal(flat, "\n").to_numpy(zero_copy_only=False)
    lead = ~line
    lead[1:] &= ~line[:-1]
    first = np.cumsum(length) - length
    lead[first[length > 0]] = True
    lead &= ~line
    full = lead | (pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0)
    row = np.repeat(np.arange(n), length)[full]
    cells = pc.binary_join_element_wise(pc.if_else(pa.array(lead[full]), MARK, ""), flat.filter(pa.array(full)), "")
    if slow.any():
        odd = [(i, CELL.findall(MARK + texts[int(i)].as_py().replace(" ", MARK))) for i in np.flatnonzero(slow)]
        row = np.concatenate([row, np.repeat([i for i, _ in odd], [len(c) for _, c in odd])]).astype(np.int64)
        cells = pa.concat_arrays([cells, pa.array([c for _, cs in odd for c in cs], pa.string())])
        order = np.argsort(row, kind="stable")
        row, cells = row[order], cells.take(pa.array(order))
    coded = cells.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.searchsorted(row, np.arange(n + 1))


class Path:
    """A segmentation of one text, and the set of those that leave it at step ``since`` or later.

    mass: the share of the set that leaves at each step, in units of exp(base); best: the set's Gumbel value.
    """

    def __init__(self, lattices: Lattices, edges: np.ndarray, cell: np.ndarray, log_prob: float, value: float, since: int, base: float):
        self.lattices, self.edges, self.cell, self.log_prob, self.value, self.since, self.base = lattices, edges, cell, log_prob, value, since, base
        self.out: dict[int, list[int]] = {}  # columns taken from the set at a step
        self.best, self.mass = -math.inf, np.empty(0)

    @staticmethod
    def weigh(paths: list[Path]) -> None:
        """Finds the mass of all paths of one batch side by side, 48 steps first and then twice as many each time."""
        live = [(p, p.since, 0.0) for p in paths if p.since < len(p.edges)]
        size, mass = 48, {id(p): [] for p in paths}
        while live:
            parts = [p.edges[done : done + size] for p, done, _ in live]
            many = np.fromiter(map(len, parts), np.int64, len(parts))
            log = np.zeros((len(parts), size))
            log[np.arange(size) < many[:, None]] = live[0][0].lattices.log[np.concatenate(parts)]
            sums = np.array([before for _, _, before in live])[:, None] + np.cumsum(log, axis=1)
            own = np.exp(sums - log) * -np.expm1(log)  # a node's only edge has log 0, and so no mass
            for (p, _, _), row, n in zip(live, own, many.tolist(), strict=True):
                mass[id(p)].append(row[:n].copy())
            ends = sums[:, -1].tolist()
            live = [(p, done + size, end) for (p, done, _), end in zip(live, ends, strict=True) if done + size < len(p.edges) and end > -50]
            size *= 2
        for p in paths:
            if mass[id(p)]:
                p.mass = np.concatenate(mass[id(p)])

    def draw(self, u: float, top: float) -> None:
        total = float(self.mass.sum()) if len(self.mass) else 0.0
        self.best = gumbel(self.base + math.log(total), u, top) if total > 0 else -math.inf

    def open(self, u: float, v: float) -> tuple[int, int, float]:
        """A step and an edge by their mass, which leaves the set; and the log probability before the step."""
        step = min(int(np.searchsorted(np.cumsum(self.mass), u * float(self.mass.sum()), "right")), len(self.mass) - 1)
        while self.mass[step] == 0.0:
            step -= 1
        at = self.since + step
        own, row = divmod(int(self.edges[at]), self.lattices.rows)
        share = np.exp(np.ascontiguousarray(self.lattices.by_column[:, row]))
        share[[own, *self.out.get(at, [])]] = 0.0
        column = min(int(np.searchsorted(np.cumsum(share), v * float(share.sum()), "right")), len(share) - 1)
        while share[column] == 0.0:
            column -= 1
        self.out.setdefault(at, []).append(column)
        before = float(self.lattices.log[self.edges[self.since : at]].sum())
        share[column] = 0.0
        self.mass[step] = math.exp(before) * float(share.sum())
        return at, column * self.lattices.rows + row, self.base + before


def samples(texts: pa.Array, keys: np.ndarray, words: Vocabulary, k: int) -> list[tuple[list[Path], float, Lattices | None]]:
    """For each text its k segmentations, best perturbed value first, and the threshold."""
    code, cells, first = cut(texts)
    n, none = len(texts), np.empty(0, np.int64)
    lattices = Lattices(cells, words) if cells else None
    seed = lambda sample, d, cell: mix(keys[d] + (cell.astype(np.uint64) << np.uint64(8)) + np.uint64(sample))
    chance = lambda sample: [uniform(mix(keys ^ np.uint64(0xA5A5 << 32)), 8 * sample + j).tolist() for j in range(4)]
    if not len(code):
        return [([Path(lattices, none, none, 0.0, -math.log(-math.log(max(u, 1e-300))), 0, 0.0)], -math.inf, None) for u in chance(0)[0]]
    doc = np.repeat(np.arange(n), np.diff(first))
    within = np.arange(len(code)) - first[doc]
    nodes = lattices.first[code]
    edges, cell = lattices.walk(nodes, seed(0, doc, within))
    ends = np.searchsorted(doc[cell], np.arange(n + 1)).tolist()
    sums = np.concatenate([[0.0], np.cumsum(lattices.log[edges])])
    u = chance(0)
    found = []
    for d in range(n):
        a, b = ends[d], ends[d + 1]
        value = -math.log(-math.log(max(u[0][d], 1e-300)))
        found.append([Path(lattices, edges[a:b], within[cell[a:b]], float(sums[b] - sums[a]), value, 0, 0.0)])
    Path.weigh([paths[0] for paths in found])
    for d, (path,) in enumerate(found):
        path.draw(u[1][d], path.value)
    for sample in range(1, k):
        u, opened = chance(sample), []
        for d in range(n):
            path = max(found[d], key=lambda p: p.best)
            if len(found[d]) == sample and path.best > -math.inf:
                value = path.best
                step, edge, before = path.open(u[0][d], u[1][d])
                path.draw(u[2][d], value)
                opened.append((d, path, step, edge, before, value))
        if not opened:
            break
        # One walk for all texts: the rest of the opened cell, and all cells after it.
        cells_at = np.array([p.cell[s] for _, p, s, _, _, _ in opened])
        of = np.array([o[0] for o in opened])
        many = first[of + 1] - first[of] - cells_at
        stops = np.cumsum(many)
        whose = np.repeat(np.arange(len(opened)), many)
        later = np.arange(len(whose)) - (stops - many)[whose] + cells_at[whose]
        start = nodes[first[of][whose] + later]
        start[stops - many] = lattices.end(np.array([o[3] for o in opened]))
        edges, cell = lattices.walk(start, seed(sample, of[whose], later))
        cuts = np.searchsorted(cell, np.append(0, stops)).tolist()
        sums = np.concatenate([[0.0], np.cumsum(lattices.log[edges])])
        for i, (d, p, s, edge, before, value) in enumerate(opened):
            a, b = cuts[i], cuts[i + 1]
            whole = np.concatenate([p.edges[:s], [edge], edges[a:b]])
            base = before + float(lattices.log[edge])
            path = Path(lattices, whole, np.concatenate([p.cell[: s + 1], later[cell[a:b]]]), base + float(sums[b] - sums[a]), value, s + 1, base)
            found[d].append(path)
        Path.weigh([found[o[0]][-1] for o in opened])
        for d, *_ in opened:
            found[d][-1].draw(u[3][d], found[d][-1].value)
    return [(paths, max(p.best for p in paths), lattices) for paths in found]


def sampled_segmentations(docs: DataFrame, model: str, k: int = 3, alpha: float = 1.0, seed: int = 13, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to k rows of SCHEMA per row of docs, and the ids if asked for."""

    def make():
        words = Vocabulary.at(model, alpha)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pc.fill_null(batch.column("text"), "")
            row_ids = batch.column("doc_id").to_pylist()
            plain = [t.as_py().encode() for t in texts]
            base = np.fromiter((zlib.crc32(t) if i is None else i & 0xFFFFFFFFFFFFFFFF for i, t in zip(row_ids, plain, strict=True)), np.uint64, len(plain))
            keys = mix(base + mix(np.array([seed], np.uint64)))
            rows, listed = [], []
            for row_id, text, (paths, threshold, lattices) in zip(row_ids, plain, samples(texts, keys, words, k), strict=True):
                want = text.replace(MARK.encode(), b" ")
                for sample, p in enumerate(paths, 1):
                    gap = p.log_prob - threshold
                    inclusion = 0.0 if gap > 700 else gap if gap < -30 else float(np.log(-np.expm1(-np.exp(gap))))
                    listed.append(lattices.piece[p.edges] if len(p.edges) else np.empty(0, np.int32))
                    rows.append((row_id, sample, p.log_prob, p.value, inclusion, want))
            names = ["doc_id", "sample", "log_prob", "perturbed", "log_inclusion", "round_trip"]
            out = dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
            ids, bounds = words.expand_many(np.concatenate(listed), np.concatenate([[0], np.cumsum(list(map(len, listed)))]))
            spelt = ids.astype("<u4")
            out["n_tokens"] = np.diff(bounds)
            out["ids_crc32"] = [zlib.crc32(spelt[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            out["round_trip"] = [a == b for a, b in zip(out["round_trip"], words.decode_many(ids, bounds), strict=True)]
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            kinds = {"doc_id": pa.int64(), "sample": pa.int32(), "round_trip": pa.bool_(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
            names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids
            return pa.RecordBatch.from_pydict({c: out[c] if c == "ids" else pa.array(out[c], kinds.get(c, pa.float64())) for c in names})

        return work

    return mapped(ids_and_text(docs, id_col, text_col), make, SCHEMA + ", ids array<int>" * with_ids, most=SLICE_BYTES)


def decoded(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """rows with their own columns, and the texts of their ids in place of these."""

    def work(batches):
        words = Vocabulary.at(model, 1.0)
        for batch in batches:
            texts = [None if ids is None else words.decode(ids).decode("utf-8", "replace") for ids in batch.column(ids_col).to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(ids_col), ids_col, pa.array(texts, pa.string()))

    schema = ", ".join(f"`{f.name}` {'string' if f.name == ids_col else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, schema)
