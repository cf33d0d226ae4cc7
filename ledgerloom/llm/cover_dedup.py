"""Exact links of embeddings by cosine, with cover trees traversed two at a time.

Vectors are scaled to length 1; a cosine of at least t is a distance of at most sqrt(2 - 2 t). Equal
vectors are one node with a count. A bounded sample gives the top of the tree: nested centres at radii
that halve, at most ``TOP_NODES`` of them; every vector goes to its nearest centre. A cell of any size is dealt
into blocks of bounded size, and a block into tiles of neighbouring vectors. Every tile has a cover tree (nested
levels of centres, each with the radius that covers what is below it). Pairs of blocks and of tiles whose balls
are too far apart are pruned; in every pair of tiles that is left, the two trees are walked together, pruning
node pairs by their radii; node pairs that lie within the bound as a whole are linked as a whole, and what is
left at the leaves is tested by exact products in double precision. The products that prune are first bounded
from above: by a few principal directions in single precision and the lengths of what they leave.

**Disk.** A vector moves once, as it was given: to the task that writes its block, with the tile's tree, as a file
in the shared folder. Tasks get pairs of groups of blocks as names and read the files themselves, so nothing
that grows with the number of pairs is shuffled or stored but counts per vector and spanning forests of links.
Files lie in any file system that pyarrow knows; the table of nodes lists only what the tasks that counted wrote.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ledgerloom.llm.graph import components
from ledgerloom.llm.tables import materialize
from ledgerloom.llm.vectors import matrix, packed, selected, unpacked
from ledgerloom.llm.warc import _open, _store
from ledgerloom.session import scratch_path

LEAST_COSINE = 0.9
TOP_NODES = 64
SAMPLE_ROWS = 2_000  # bound of the sample that gives the top centres
BLOCK_NUMBERS = 1 << 18  # numbers of one tile: rows times components
BLOCK_ROWS = 2_048
GROUP_NUMBERS = 1 << 22  # numbers of one group of blocks, which a task holds two of
GROUPS = 24  # of smaller tables, so that all tasks have some
LEAST_GROUP = 4_096
HELD_BYTES = 16 << 20  # of distinct vectors a task holds before it sends them on
DEAL_BYTES = 16 << 20
RUNS = 400  # least tasks, where there are so many pairs of groups
LONGEST_RUN = 8
FEWER, MUCH_FEWER = 0.9, 0.25  # a level of more centres for the rows saves nothing
NARROW = 5  # wider balls than so many leaves' radii meet most others, so that only few of them save something
LOW = 20  # principal directions of the first bound
LOW_SLACK = 1e-5  # of products of LOW + 1 numbers in single precision
LARGE_FAN = 1 << 10  # pairs of children that are met as a matrix
LOW_FROM = 1 << 12  # products from which the first bound is worth its call
STRIP = 256
WIDE_STRIP = 512
FRONTIER = 1 << 18  # node pairs that are followed down at a time
SLACK = 1e-9  # of bounds only, for rounding; links are decided by the product itself
CHORD_SLACK = 1e-7  # of radii, whose chords may be so short that rounding shows
PLACE_SHIFT = 32  # a node's number is its block and its row there


def distance(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def nested_centres(x: np.ndarray, radius: float, start: list[int], gram: np.ndarray | None = None) -> list[int]:
    """Rows that cover all within ``radius``, beginning with those of the level above. ``gram`` holds all products, if known."""
    centres, bound = list(start), 1 - radius**2 / 2
    products = (lambda c: gram[c]) if gram is not None else (lambda c: x @ x[c])
    covered = np.zeros(len(x), bool)
    for c in centres:
        covered |= products(c) >= bound
    for c in range(len(x)):
        if not covered[c]:
            centres.append(c)
            covered |= products(c) >= bound
            covered[c] = True
    return centres


class Spans:
    """A list of arrays that lie one behind the other in one array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.ends = flat, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        if not -len(self) <= i < len(self):
            raise IndexError(i)
        i %= len(self)
        return self.flat[self.ends[i] : self.ends[i + 1]]

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends)

    def joined(self, at: np.ndarray) -> np.ndarray:
        """The arrays ``at`` these places, one behind the other."""
        starts, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        return self.flat[np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())] if len(at) else self.flat[:0]

    def over(self, below: Spans) -> Spans:
        """For each array of places in ``below``, what lies there."""
        sizes = np.concatenate([[0], np.cumsum(below.sizes[self.flat])])
        return Spans(below.joined(self.flat), sizes[self.ends[1:]] - sizes[self.ends[:-1]])


@dataclass
class Level:
    """Centres of one level as rows of the tile, the radius and the rows below each, and its children in the next level."""

    centre: np.ndarray
    radius: np.ndarray
    children: Spans
    members: Spans


def _isolated_first(near: np.ndarray, start: list[int]) -> list[int]:
    """As :func:`nested_centres`, where ``near`` says which rows cover which: rows that nothing else covers need no turn."""
    covered = near[start].any(axis=0) if start else np.zeros(len(near), bool)
    alone = np.count_nonzero(near, axis=1) <= 1
    found = np.flatnonzero(alone & ~covered).tolist()
    for c in np.flatnonzero(~alone).tolist():
        if not covered[c]:
            found.append(c)
            covered |= near[c]
            covered[c] = True
    return list(start) + sorted(found)


def cover_tree(x: np.ndarray, least: float) -> list[Level]:
    """Levels from the root down to leaves of single rows; radii halve until ``least``.

    Each centre of a level hangs below the nearest centre of the level above. A level that has nearly as
    many centres as there are rows is left out.
    """
    layers: list[np.ndarray] = [np.zeros(1, np.int64)]
    gram = (short := x.astype(np.float32)) @ short.T if len(x) <= BLOCK_ROWS else None  # steers the shape; radii are taken in double precision
    radius, rows = 1.0, np.arange(len(x))
    while radius >= least and len(layers[-1]) < len(x):
        start = layers[-1].tolist()
        centres = np.array(nested_centres(x, radius, start) if gram is None else _isolated_first(gram >= 1 - radius**2 / 2, start), np.int64)
        if len(layers[-1]) < len(centres) <= (FEWER if radius <= NARROW * least else MUCH_FEWER) * len(x):
            layers.append(centres)
        radius /= 2
    if len(layers[-1]) < len(x):
        layers.append(rows)
    nothing = Spans(np.zeros(0, np.int64), np.zeros(len(layers[-1]), np.int64))
    levels = [Level(layers[-1], np.zeros(len(layers[-1])), nothing, Spans(layers[-1], np.ones(len(layers[-1]), np.int64)))]
    for upper, lower in zip(layers[-2::-1], layers[:0:-1]):
        place = np.full(len(x), -1)
        place[upper] = np.arange(len(upper))
        nearest = place[lower]  # a centre of both levels hangs below itself
        rest = np.flatnonzero(nearest < 0)
        for s in range(0, len(rest), STRIP):
            nearest[rest[s : s + STRIP]] = np.argmax(x[lower[rest[s : s + STRIP]]] @ x[upper].T, axis=1)
        children = Spans(np.argsort(nearest, kind="stable"), np.bincount(nearest, minlength=len(upper)))
        levels.append(_level(x, upper, children, levels[-1]))
    return levels[::-1]


def _level(x: np.ndarray, centre: np.ndarray, children: Spans, below: Level) -> Level:
    members = children.over(below.members)
    to = np.repeat(centre, members.sizes)
    chord = np.zeros(len(to))
    apart = np.flatnonzero(to != members.flat)
    step = max(1, (1 << 21) // x.shape[1])
    for s in range(0, len(apart), step):
        at = apart[s : s + step]
        chord[at] = _chords(np.einsum("ij,ij->i", x[to[at]], x[members.flat[at]])) + CHORD_SLACK
    cover = np.zeros(len(centre))
    some = np.flatnonzero(members.sizes)
    cover[some] = np.maximum.reduceat(chord, members.ends[some]) if len(some) else 0
    return Level(centre, cover, children, members)


def flat_tree(levels: list[Level]) -> tuple[np.ndarray, np.ndarray]:
    """A tree as one array of whole numbers and one of radii, without the members."""
    whole = [np.array([len(levels), *(len(v.centre) for v in levels)])]
    for level in levels[:-1]:
        whole += [level.centre, level.children.sizes, level.children.flat]
    return np.concatenate([*whole, levels[-1].centre]).astype(np.int32), np.concatenate([v.radius for v in levels])


def grown_tree(whole: np.ndarray, radii: np.ndarray) -> list[Level]:
    """The tree of :func:`flat_tree`."""
    whole = whole.astype(np.int64)
    sizes, at, parts = whole[1 : 1 + whole[0]], 1 + int(whole[0]), []
    for n, lower in zip(sizes, [*sizes[1:], 0]):
        cuts = [n, n, lower] if len(parts) < len(sizes) - 1 else [n]
        ends = at + np.cumsum(cuts)
        parts.append(np.split(whole[at : ends[-1]], np.cumsum(cuts)[:-1]))
        at = int(ends[-1])
    radius = np.split(radii, np.cumsum(sizes)[:-1])
    leaves = parts[-1][0]
    levels = [Level(leaves, radius[-1], Spans(leaves[:0], np.zeros(len(leaves), np.int64)), Spans(leaves, np.ones(len(leaves), np.int64)))]
    for (centre, sizes_, flat), r in zip(parts[-2::-1], radius[-2::-1]):
        children = Spans(flat, sizes_)
        levels.append(Level(centre, r, children, children.over(levels[-1].members)))
    return levels[::-1]


def _chords(products: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * products))


def _rare(hit: np.ndarray) -> np.ndarray:
    """Places of the few that are true, looked for eight at a time."""
    whole = len(hit) & ~7
    eights = np.flatnonzero(hit[:whole].view(np.uint64) != 0)
    places = (8 * eights[:, None] + np.arange(8)).ravel()
    return np.concatenate([places[hit[places]], whole + np.flatnonzero(hit[whole:])])


def _below(tree: list[Level], u: int) -> Spans:
    """Children of a level's nodes; leaves stand for themselves."""
    leaves = tree[u].centre
    return tree[u].children if u < len(tree) - 1 else Spans(np.arange(len(leaves)), np.ones(len(leaves), np.int64))


def dual_pairs(
    x: np.ndarray, y: np.ndarray, tree_x: list[Level], tree_y: list[Level], cosine: float, same: bool = False, low_x: np.ndarray | None = None, low_y: np.ndarray | None = None
) -> Iterator[tuple]:
    """Links between two tiles, found by descending both trees together.

    Yields (False, rows of x, rows of y): pairs with a product of at least ``cosine``, and
    (True, rows of x, rows of y): sets of rows that are linked each with each. With ``same`` both are one
    tile: every unordered pair comes once, and a True with one set twice links the set within.
    ``low_x`` and ``low_y`` are the rows of :func:`lowered`; without them no product is bounded first.
    """
    reach = distance(cosine)
    last_x, last_y = len(tree_x) - 1, len(tree_y) - 1
    step = max(1, (1 << 21) // max(1, x.shape[1]))

    def products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.concatenate([np.einsum("ij,ij->i", x[p[s : s + step]], y[q[s : s + step]]) for s in range(0, len(p), step)] or [np.zeros(0)])

    def close(p: np.ndarray, q: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``p`` and ``q`` of the pairs with a product of at least ``bound``, and the product."""
        if low_x is not None and len(p) * len(q) >= LOW_FROM:
            hit = low_x[p] @ low_y[q].T >= bound - LOW_SLACK
            if np.count_nonzero(hit) * 20 <= hit.size:
                r, c = np.divmod(_rare(hit.ravel()), len(q))
                found = products(p[r], q[c])
                over = found >= bound
                return r[over], c[over], found[over]
        found = x[p] @ y[q].T
        r, c = np.nonzero(found >= bound)
        return r, c, found[r, c]

    def halves(nodes: np.ndarray, radius: np.ndarray) -> list[np.ndarray]:
        """Nodes of one row apart from the others, so that they are met at their own bound."""
        return [part for part in (nodes[radius[nodes] > 0], nodes[radius[nodes] == 0]) if len(part)]

    def kept(lower_a: Level, lower_b: Level, a: np.ndarray, b: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, ...]:
        """Node pairs that are linked as a whole, and those that must be followed."""
        chord, radii = _chords(product), lower_a.radius[a] + lower_b.radius[b]
        whole = chord + radii <= reach - SLACK
        near = (chord - radii <= reach + SLACK) & ~whole
        return a[whole], b[whole], a[near], b[near]

    def fans(u: int, v: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple]:
        """Children pairs of node pairs: large fans by strips, small ones many at a time."""
        lower_a, lower_b = tree_x[min(u + 1, last_x)], tree_y[min(v + 1, last_y)]
        below_a, below_b = _below(tree_x, u), _below(tree_y, v)
        itself = same & (i == j)
        order = np.lexsort((itself, i))
        i, j, itself = i[order], j[order], itself[order]
        many_a, many_b = below_a.sizes[i], below_b.sizes[j]
        # a node against all it must meet at once; against itself apart
        cuts = np.flatnonzero((np.diff(i, prepend=-1) != 0) | (np.diff(itself, prepend=False) != 0))
        large = many_a[cuts] * np.add.reduceat(many_b, cuts) >= LARGE_FAN
        ends = np.append(cuts[1:], len(i))
        for s, e in zip(cuts[large], ends[large]):
            half_a, half_b = halves(below_a[i[s]], lower_a.radius), halves(below_b.joined(j[s:e]), lower_b.radius)
            for half, b in product(half_a, half_b):
                for t in range(0, len(half), WIDE_STRIP):
                    a = half[t : t + WIDE_STRIP]
                    # one comparison for all pairs of the strip, the exact bounds for what it leaves
                    widest = min(2.0, reach + SLACK + float(lower_a.radius[a].max() + lower_b.radius[b].max()))
                    r, c, found = close(lower_a.centre[a], lower_b.centre[b], 1 - widest**2 / 2)
                    p, q = a[r], b[c]
                    if itself[s]:
                        upper = p <= q
                        p, q, found = p[upper], q[upper], found[upper]
                    yield kept(lower_a, lower_b, p, q, found)
        small = np.flatnonzero(~np.repeat(large, ends - cuts))
        sizes = np.cumsum(many_a[small] * many_b[small])
        for at in np.split(small, np.searchsorted(sizes, np.arange(FRONTIER, sizes[-1], FRONTIER), "right")) if len(small) else []:
            fan = many_a[at] * many_b[at]
            pair = np.repeat(np.arange(len(at)), fan)
            place = np.arange(len(pair)) - (np.cumsum(fan) - fan)[pair]
            r, c = np.divmod(place, many_b[at][pair])
            p, q = below_a.flat[below_a.ends[i[at]][pair] + r], below_b.flat[below_b.ends[j[at]][pair] + c]
            upper = ~itself[at][pair] | (p <= q)
            p, q = p[upper], q[upper]
            yield kept(lower_a, lower_b, p, q, products(lower_a.centre[p], lower_b.centre[q]))

    def descend(u: int, v: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple]:
        if u == last_x and v == last_y:
            a, b = tree_x[u].centre[i], tree_y[v].centre[j]
            apart = ~(same & (a == b))
            a, b = a[apart], b[apart]
            for s in range(0, len(a), step):
                p, q = a[s : s + step], b[s : s + step]
                ok = products(p, q) >= cosine
                yield False, p[ok], q[ok]
            return
        below_u, below_v = min(u + 1, last_x), min(v + 1, last_y)
        members_x, members_y = tree_x[below_u].members, tree_y[below_v].members
        held_i, held_j, held = [], [], 0
        for whole_i, whole_j, near_i, near_j in fans(u, v, i, j):
            single = (members_x.sizes[whole_i] == 1) & (members_y.sizes[whole_j] == 1)
            a, b = members_x.joined(whole_i[single]), members_y.joined(whole_j[single])
            apart = ~(same & (a == b))
            yield False, a[apart], b[apart]
            for p, q in zip(whole_i[~single], whole_j[~single]):
                mine = members_x[p]
                yield True, mine, mine if same and p == q else members_y[q]
            held_i.append(near_i)
            held_j.append(near_j)
            held += len(near_i)
            if held >= FRONTIER:
                yield from descend(below_u, below_v, np.concatenate(held_i), np.concatenate(held_j))
                held_i, held_j, held = [], [], 0
        if held:
            yield from descend(below_u, below_v, np.concatenate(held_i), np.concatenate(held_j))

    yield from descend(0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64))


def principal(x: np.ndarray, most: int = LOW) -> np.ndarray:
    """Orthonormal columns along which the rows of ``x`` are long; any such columns give a right bound."""
    small = x @ x.T if len(x) < x.shape[1] else x.T @ x
    _, v = np.linalg.eigh(small)
    v = v[:, ::-1][:, :most]
    if len(x) < x.shape[1]:
        v = x.T @ v
    return np.linalg.qr(v)[0]


def lowered(unit: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Components along ``directions`` and the length of the rest: products of two such rows are never below those of the units."""
    along = unit @ directions
    rest = unit - along @ directions.T
    return np.concatenate([along, np.sqrt((rest * rest).sum(axis=1))[:, None]], axis=1).astype(np.float32)


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are not zero, and those at length 1."""
    norm = np.sqrt((x * x).sum(axis=1))
    # scaled first where squares overflow or vanish
    big = np.abs(x).max(axis=1)
    odd = ~np.isfinite(norm) | (norm < 1e-150)
    if odd.any():
        x = x.copy()
        x[odd] /= np.where(big[odd] > 0, big[odd], 1)[:, None]
        norm[odd] = np.sqrt((x[odd] * x[odd]).sum(axis=1))
    keep = big > 0
    return keep, x[keep] / norm[keep][:, None] + 0.0


def _keyed(batch: pa.RecordBatch, centres: np.ndarray) -> Iterator[tuple]:
    """By number of components: rows that are not zero, key and cell of each, and the vectors as they were given."""
    kind = np.float32 if pa.types.is_float32(batch.schema.field("v").type.value_type) else np.float64
    for rows, x in matrix(batch, "v"):
        keep, unit = scaled(x)
        raw = (x[keep] + 0.0).astype(kind)
        keys = [blake2b(r, digest_size=16).digest() for r in raw]
        # another number of components is a cell of its own
        cell = np.argmax(unit @ centres.T, axis=1) if x.shape[1] == centres.shape[1] else np.full(len(unit), -x.shape[1] - 1)
        yield rows[keep], keys, cell, raw


def _keys(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, keys, cell, _ in _keyed(batch, centres):
                yield pa.record_batch([batch.column("id").take(pa.array(rows)), pa.array(keys, pa.binary()), pa.array(cell, pa.int32())], names=["id", "key", "cell"])

    return run


_DEALT = ("block", "key", "id", "n", "raw")


def _dealt(centres: np.ndarray, first: dict[int, int], parts: dict[int, int]):
    """Distinct vectors of a task with their block, least id and number of rows. Copies from other tasks meet in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*((block, key, least, n, raw) for key, (block, least, n, raw) in held.items())))
            held.clear()
            kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(_DEALT))

        for batch in batches:
            for rows, keys, cell, raw in _keyed(batch, centres):
                ids = batch.column("id").take(pa.array(rows)).to_pylist()
                for at, (key, c, least) in enumerate(zip(keys, cell.tolist(), ids)):
                    known = held.get(key)
                    if known is None:
                        held[key] = [first[c] + int.from_bytes(key[:8], "big") % parts[c], least, 1, raw[at].tobytes()]
                        size += raw.itemsize * raw.shape[1]
                        if size >= HELD_BYTES:
                            yield flushed()
                            size = 0
                    else:
                        known[1], known[2] = min(known[1], least), known[2] + 1
        if held:
            yield flushed()

    return run


def _ordered(unit: np.ndarray) -> np.ndarray:
    """Rows in an order in which neighbours are close: by nearest of a few centres of their own, then by distance."""
    sample = unit[:: max(1, len(unit) // BLOCK_ROWS)][:BLOCK_ROWS]
    top, radius = [0], 1.0
    while len(top) < TOP_NODES and radius >= 0.25:
        top = nested_centres(sample, radius, top) if len(sample) > BLOCK_ROWS else _isolated_first(sample @ sample.T >= 1 - radius**2 / 2, top)
        radius /= 2
    products = unit @ sample[top[:TOP_NODES]].T
    nearest = np.argmax(products, axis=1)
    return np.lexsort((-products[np.arange(len(unit)), nearest], nearest))


def _tile_rows(width: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // width))


def _stored(folder: str, least: float, kind: type):
    """Writes a file for every block: vectors in the order of the tiles, counts, the tiles' sizes, centres, radii and trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, ids, counts, vectors = None, [], [], [], []

        def done() -> pa.RecordBatch:
            width = len(vectors[0]) // kind().itemsize
            raw = unpacked(vectors, kind)
            unit = scaled(raw.astype(np.float64))[1]
            order = _ordered(unit) if len(unit) > 1 else np.zeros(1, np.int64)
            raw, unit = raw[order], unit[order]
            n, tile = np.array(counts, np.int64)[order], _tile_rows(width)
            middles, radii, trees, covers = [], [], [], []
            for s in range(0, len(unit), tile):
                x = unit[s : s + tile]
                middle = x.sum(axis=0)
                length = np.linalg.norm(middle)
                middle = middle / length if length > 1e-6 else x[0]
                middles.append(middle)
                radii.append(_chords(x @ middle).max() + CHORD_SLACK)
                whole, cover = flat_tree(cover_tree(x, least))
                trees.append(whole)
                covers.append(cover)
            # the middle of the block covers its tiles
            centre = np.sum(middles, axis=0)
            length = np.linalg.norm(centre)
            centre = centre / length if length > 1e-6 else middles[0]
            far = float(_chords(unit @ centre).max()) + CHORD_SLACK
            sizes = np.array([[len(t), len(c)] for t, c in zip(trees, covers)], np.int64)
            data = io.BytesIO()
            np.savez(data, raw=raw, n=n, middles=np.array(middles), radii=np.array(radii), sizes=sizes, trees=np.concatenate(trees), covers=np.concatenate(covers))
            name = f"{uuid.uuid4().hex}.npz"
            store, root = _store(folder)
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{name}") as stream:
                stream.write(data.getbuffer())
            place = (block << PLACE_SHIFT) + np.arange(len(unit))
            once = lambda value, type_: pa.array([value] + [None] * (len(unit) - 1), type_)
            return pa.record_batch(
                [
                    pa.array(place),
                    pa.array([keys[o] for o in order], pa.binary()),
                    pa.array(np.array(ids, np.int64)[order]),
                    pa.array(n),
                    once(f"{folder}/{name}", pa.string()),
                    once(width, pa.int32()),
                    once(len(unit), pa.int32()),
                    once(packed(centre[None])[0].as_py(), pa.binary()),
                    once(far, pa.float64()),
                ],
                names=[f.split()[0] for f in NODES.split(", ")],
            )

        for batch in batches:
            for own, key, least_id, n, vector in zip(*(batch.column(c).to_pylist() for c in _DEALT)):
                if own != block:
                    if keys:
                        yield done()
                    block, keys, ids, counts, vectors = own, [], [], [], []
                if keys and keys[-1] == key:
                    ids[-1], counts[-1] = min(ids[-1], least_id), counts[-1] + n
                else:
                    keys.append(key)
                    ids.append(least_id)
                    counts.append(n)
                    vectors.append(vector)
        if keys:
            yield done()

    return run


NODES = "place long, key binary, id long, n long, file string, width int, rows int, centre binary, far double"


@dataclass
class Tile:
    """Vectors of a tile, its tree, its ball and the place of its first row in the group."""

    x: np.ndarray
    low: np.ndarray | None
    tree: list[Level]
    at: int


class Group:
    """Blocks a task holds: tiles, their balls, and number and count of every row."""

    def __init__(self, blocks: list[tuple[int, str]], directions: np.ndarray) -> None:
        self.tiles, places, counts, middles, radii, at = [], [], [], [], [], 0
        for block, file in blocks:
            with _open(file) as stream, np.load(io.BytesIO(stream.read()), allow_pickle=False) as held:
                part = {k: held[k] for k in held.files}
            unit = scaled(part["raw"].astype(np.float64))[1]
            low = lowered(unit, directions) if unit.shape[1] == directions.shape[0] else None
            tile, tree, cover = _tile_rows(unit.shape[1]), 0, 0
            for k, (wholes, covers) in enumerate(part["sizes"].tolist()):
                s = slice(k * tile, (k + 1) * tile)
                grown = grown_tree(part["trees"][tree : tree + wholes], part["covers"][cover : cover + covers])
                self.tiles.append(Tile(unit[s], None if low is None else low[s], grown, at + k * tile))
                tree, cover = tree + wholes, cover + covers
            places.append((block << PLACE_SHIFT) + np.arange(len(unit)))
            counts.append(part["n"])
            middles.append(part["middles"])
            radii.append(part["radii"])
            at += len(unit)
        self.place, self.n = np.concatenate(places), np.concatenate(counts)
        self.middles, self.radii = np.concatenate(middles), np.concatenate(radii)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the least node it reaches through the given links."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _met(a: Group, b: Group, cosine: float, count_a: np.ndarray, count_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds the links between two groups to the counts; a spanning forest of them, as places."""
    same = a is b
    bound = a.radii[:, None] + b.radii[None] + distance(cosine) + SLACK
    tails, heads, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for i, j in zip(*np.nonzero(_chords(a.middles @ b.middles.T) <= bound)):
        if same and i > j:
            continue
        s, t = a.tiles[i], b.tiles[j]
        own = same and i == j
        for whole, p, q in dual_pairs(s.x, t.x, s.tree, t.tree, cosine, own, s.low, t.low):
            if not len(p):
                continue
            within = whole and own and p is q
            p, q = p + s.at, q + t.at
            if within:
                count_a[p] += a.n[p].sum() - a.n[p]
                p, q = p[1:], np.full(len(p) - 1, p[0])
            elif whole:
                count_a[p] += b.n[q].sum()
                count_b[q] += a.n[p].sum()
                # a spanning tree: all of one side to one of the other, and back
                p, q = np.concatenate([p, np.full(len(q) - 1, p[0])]), np.concatenate([np.full(len(p), q[0]), q[1:]])
            else:
                np.add.at(count_a, p, b.n[q])
                np.add.at(count_b, q, a.n[p])
            tails.append(a.place[p])
            heads.append(b.place[q])
            held += len(p)
            if held >= FRONTIER:
                tails, heads = [[side] for side in _forest(np.concatenate(tails), np.concatenate(heads))]
                held = 0
    return _forest(np.concatenate(tails), np.concatenate(heads))


def _links(cosine: float, directions: np.ndarray):
    """Rows of two lists of blocks each: counts of the vectors with links, and a spanning forest of the links."""

    def rows(places: np.ndarray, counts: np.ndarray, other: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(places), pa.int64())
        return pa.record_batch([pa.array(places), pa.array(counts) if other is None else none, none if other is None else pa.array(other)], names=["place", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mine = [(b["block"], b["file"]) for b in row["mine"]]
                a, forest = None, (np.zeros(0, np.int64), np.zeros(0, np.int64))
                for other in row["others"]:
                    # blocks that lie too far from all of the other side are not read
                    if not _near(row["mine"], other["blocks"], cosine):
                        continue
                    if a is None:
                        a = Group(mine, directions)
                        count_a = np.zeros(len(a.n), np.int64)
                    theirs = [(b["block"], b["file"]) for b in other["blocks"]]
                    b = a if theirs == mine else Group(theirs, directions)
                    count_b = count_a if b is a else np.zeros(len(b.n), np.int64)
                    tails, heads = _met(a, b, cosine, count_a, count_b)
                    if len(tails):
                        forest = _forest(np.concatenate([forest[0], tails]), np.concatenate([forest[1], heads]))
                    if b is not a and len(hit := np.flatnonzero(count_b)):
                        yield rows(b.place[hit], count_b[hit])
                if a is not None and len(hit := np.flatnonzero(count_a)):
                    yield rows(a.place[hit], count_a[hit])
                if len(forest[0]):
                    yield rows(forest[0], forest[0], forest[1])

    return run


def _near(mine: list[dict], theirs: list[dict], cosine: float) -> bool:
    x, y = unpacked([b["centre"] for b in mine]), unpacked([b["centre"] for b in theirs])
    far = np.array([b["far"] for b in mine])[:, None] + np.array([b["far"] for b in theirs])[None]
    return bool((_chords(x @ y.T) <= far + distance(cosine) + SLACK).any())


def _runs(spark: SparkSession, nodes: DataFrame, most: int) -> DataFrame:
    """Work of the tasks: (mine, others), a group of blocks and the groups it meets. Each pair of groups of one width comes once."""
    listed = nodes.filter("file IS NOT NULL").select(F.shiftright("place", PLACE_SHIFT).alias("block"), "width", "rows")
    groups, before = [], None  # a row for every block, of at most ``most`` rows unless its cell is small
    for block, width, rows in sorted(map(tuple, listed.collect()), key=lambda b: (b[1], b[0])):
        bound = max(1, min(most, GROUP_NUMBERS // width))
        if before is None or before[0] != width or before[1] + rows > bound:
            number = 0 if before is None or before[0] != width else before[2] + 1
            before = (width, 0, number)
        before = (width, before[1] + rows, before[2])
        groups.append((block, width, before[2]))
    table = spark.createDataFrame(groups, "block long, width int, grp int")
    blocks = nodes.filter("file IS NOT NULL").select(F.shiftright("place", PLACE_SHIFT).alias("block"), "file", "centre", "far")
    blocks = blocks.join(table, "block").groupBy("width", "grp").agg(F.sort_array(F.collect_list(F.struct("block", "file", "centre", "far"))).alias("blocks"))
    blocks = materialize(blocks, "cover-groups")
    last = {width: number for _, width, number in groups}
    pairs = sum((n + 1) * (n + 2) // 2 for n in last.values())
    run = max(1, min(LONGEST_RUN, pairs // RUNS))
    ends = spark.createDataFrame(list(last.items()), "width int, last int")
    wanted = ends.withColumn("grp", F.explode(F.sequence(F.lit(0), "last"))).withColumn("other", F.explode(F.sequence("grp", "last")))
    wanted = wanted.withColumn("run", F.floor((F.col("other") - F.col("grp")) / run).cast("int"))
    met = wanted.join(blocks.select("width", F.col("grp").alias("other"), "blocks"), ["width", "other"])
    met = met.groupBy("width", "grp", "run").agg(F.collect_list(F.struct("blocks")).alias("others"))
    met = met.join(blocks.select("width", "grp", F.col("blocks").alias("mine")), ["width", "grp"]).select("mine", "others")
    return met.repartition(max(1, -(-pairs // run)))


def cosine_components(embeddings: DataFrame, cosine: float = LEAST_COSINE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Direct links and component of every row: vec_id, n_links, component_id, kept.

    Two vectors are linked if their cosine in double precision is at least ``cosine``; vectors of other
    lengths never are. A vector that is null, empty, zero or holds null or non-finite numbers links with
    nothing and is its own component; so is a row with a null id, whose component is null. Rows that repeat
    an id with an equal vector are counted as further copies. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"))
    given = selected(embeddings, id_column, vector_column)
    widths = given.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    width, total = widths.agg(F.max(F.struct("n", "width"))["width"], F.sum("n")).first()
    x = np.zeros((0, 0)) if width is None else _sampled(given.filter(F.size("v") == width), width, total)
    if total is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not len(x):  # the sample has zeros only
        x = np.eye(1, width)
    top, radius = [0], 1.0
    while len(top) < TOP_NODES and radius > distance(cosine) / 4:
        top = nested_centres(x, radius, top)
        radius /= 2
    centres, directions = x[top[:TOP_NODES]], principal(x)
    keys = materialize(given.mapInArrow(_keys(centres), "id long, key binary, cell int"), "cover-keys")
    # distinct vectors of TOP_NODES cells and one for each other width; an estimate, for sizes only
    cells = {c: n for c, n in keys.groupBy("cell").agg(F.approx_count_distinct("key", 0.02)).collect()}
    most = max(LEAST_GROUP, -(-sum(cells.values()) // GROUPS))
    parts, first, at = {}, {}, 0
    for c in sorted(cells):
        parts[c], first[c] = -(-cells[c] // max(1, min(most, GROUP_NUMBERS // (-c - 1 if c < 0 else width)))), at
        at += parts[c]
    kind = np.float32 if isinstance(given.schema["v"].dataType.elementType, FloatType) else np.float64
    dealt = given.mapInArrow(_dealt(centres, first, parts), "block int, key binary, id long, n long, raw binary")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(cells.values()) * kind().itemsize * width // DEAL_BYTES))
    dealt = dealt.repartition(tasks, "block").sortWithinPartitions("block", "key")
    nodes = materialize(dealt.mapInArrow(_stored(scratch_path(spark, "cover-blocks"), distance(cosine) / 4, kind), NODES), "cover-nodes")
    found = materialize(_runs(spark, nodes, most).mapInArrow(_links(cosine, directions), "place long, links long, other long"), "cover-links")
    linked = found.filter("other IS NULL").groupBy("place").agg(F.sum("links").alias("links"))
    comps = components(found.filter("other IS NOT NULL").select(F.col("place").alias("a"), F.col("other").alias("b")))
    touched = linked.join(comps.withColumnRenamed("node", "place"), "place")
    # vectors without a link or a copy need no answer
    met = materialize(nodes.select("place", "key", "id", "n").join(touched, "place", "left").filter("component IS NOT NULL OR n > 1"), "cover-met")
    met = met.withColumn("component", F.coalesce("component", "place"))
    least = met.groupBy("component").agg(F.min("id").alias("component_id"))
    answers = met.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id").distinct()
    answers = materialize(answers, "cover-answers")
    named = keys.select("id", "key").join(answers, "key", "left")
    named = named.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).distinct()
    out = rows.join(named, rows["vec_id"] == named["id"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _sampled(given: DataFrame, width: int, total: int) -> np.ndarray:
    """Units of rows taken by the hash of their id, at most 32 MB unless ``TOP_NODES`` rows are longer."""
    most = max(TOP_NODES, min(SAMPLE_ROWS, (1 << 22) // width))
    place = F.xxhash64("id")
    for every in sorted({max(1, total // (4 * most)), 1}, reverse=True):  # few rows are sorted, unless ids repeat so much that none is left
        rows = given.filter(F.pmod(place, F.lit(every)) == 0).orderBy(place, "id").limit(most).select(F.col("v").cast("array<double>")).collect()
        if len(rows) >= min(most, total) // 2:
            break
    return scaled(np.array([r[0] for r in rows], np.float64).reshape(-1, width))[1]
