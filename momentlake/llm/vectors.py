"""Vector plumbing shared by the neighbour and cluster operators: reading usable vectors, packing, coarse cells.

Rows travel packed (whole numbers of few bits where that is exact) and exact copies of one vector inside
an Arrow batch travel once with the list of their ids, so a vector that a third of all rows repeat costs
one row per batch.  Vectors that differ by a positive whole factor point the same way and count as copies.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors whose elements are whole multiples of 1/GRID and fit two bytes (times GRID) are packed as integers.
GRID = 1024


def matrix_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``column`` that are usable (not null, ``dim`` finite elements, not all zero): their positions and a float32 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    fits = (lengths == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    at = np.nonzero(fits)[0]
    values = column.values.to_numpy(zero_copy_only=False)  # null elements turn to NaN
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    if at[-1] - at[0] + 1 == len(at):
        m = values[offsets[at[0]] : offsets[at[-1] + 1]].reshape(len(at), dim)
    else:
        m = values[offsets[at][:, None] + np.arange(dim)]
    m = m.astype(np.float32, copy=False)
    ok = np.isfinite(m).all(1) & (m != 0).any(1)
    return at[ok], m[ok]


def pack(m: np.ndarray) -> list[bytes]:
    """One canonical byte string per row: if exact on the grid, integers divided by their greatest common divisor, as a plane of low bytes and as many high bits as the row's largest needs; else float32."""
    out: list[bytes] = [b""] * len(m)
    for at in range(0, len(m), 1024):
        scaled = m[at : at + 1024].astype(np.float64) * GRID
        whole = (scaled == np.rint(scaled)).all(1) & (np.abs(scaled).max(1, initial=0) < 32767)
        whole &= m.shape[1] >= 8  # a row's size must tell its bits
        ints = np.where(whole[:, None], scaled, 1).astype(np.int64)
        ints //= np.maximum(np.gcd.reduce(ints, axis=1), 1)[:, None]
        high = np.maximum(np.floor(np.log2(np.abs(ints).max(1, initial=1))).astype(int) + 2 - 8, 0)
        for h in np.unique(high[whole]):
            rows = np.nonzero(whole & (high == h))[0]
            shifted = (ints[rows] + (1 << (h + 7))).astype(np.uint16)
            packed = shifted.astype(np.uint8)
            if h:
                bits = np.unpackbits((shifted >> 8).astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - h :]
                packed = np.concatenate([packed, np.packbits(bits.reshape(len(rows), -1), axis=1)], axis=1)
            for i, r in zip(rows, packed):
                out[at + i] = r.tobytes()
        for i in np.nonzero(~whole)[0]:
            out[at + i] = m[at + i].astype("<f4").tobytes()
    return out


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    """The rows as float32 (directions; the length is not kept for integer rows). A row's size tells the bits of an element."""
    out = np.empty((len(rows), dim), np.float32)
    sizes = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    for size in np.unique(sizes):
        chosen = np.nonzero(sizes == size)[0]
        h = (int(size) - dim) * 8 // dim
        for i in range(0, len(chosen), 1024):
            part = chosen[i : i + 1024]
            raw = np.frombuffer(b"".join([rows[j] for j in part]), np.uint8).reshape(len(part), -1)
            if size == 4 * dim:
                out[part] = raw.view("<f4")
                continue
            value = raw[:, :dim].astype(np.int32)
            if h:
                bits = np.unpackbits(raw[:, dim:], axis=1)[:, : dim * h].reshape(len(part), dim, h)
                for j in range(h):
                    value += bits[:, :, j].astype(np.int32) << (7 + h - j)
            out[part] = value - (1 << (h + 7))
    return out


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, float32 (lengths in double precision)."""
    norm = np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))
    return m / norm[:, None].astype(np.float32)


def exact_cosine(rows: list[bytes], dim: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (a, b) of packed rows in double precision, rounded to 6 decimals; only the rows of a few thousand pairs are unpacked at a time."""
    out = np.empty(len(a), np.float64)
    for i in range(0, len(a), 4096):
        used, at = np.unique(np.concatenate([a[i : i + 4096], b[i : i + 4096]]), return_inverse=True)
        m = unpack([rows[j] for j in used], dim).astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", m, m))
        p, q = np.split(at, 2)
        out[i : i + 4096] = np.einsum("ij,ij->i", m[p], m[q]) / (norm[p] * norm[q])
    return np.round(out, 6)


@lru_cache(maxsize=8)
def rotation(dim: int, columns: int | None = None, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix (its first ``columns`` columns), the same for every worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :columns], np.float32)


class Cells:
    """Sibling cells: the mean of their data, unit centroids of the centred directions, and per cell a handicap and how many rows are expected there."""

    def __init__(self, mean: np.ndarray, centroids: np.ndarray, handicap: np.ndarray, expected: np.ndarray):
        self.mean, self.centroids, self.handicap, self.expected = mean, centroids, handicap, expected

    def to_bytes(self) -> list[bytes]:
        return [x.tobytes() for x in (self.mean, self.centroids, self.handicap, self.expected)]

    @classmethod
    def restored(cls, mean: bytes, centroids: bytes, handicap: bytes, expected: bytes) -> Cells:
        m = np.frombuffer(mean, np.float32)
        return cls(m, np.frombuffer(centroids, np.float32).reshape(-1, len(m)), np.frombuffer(handicap, np.float32), np.frombuffer(expected, np.float64))

    def probe(self, u: np.ndarray, probes: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """For unit rows: the ``probes`` best cells, best first, and which of them lie within ``margin`` of the best."""
        if len(u) > 2048:  # bounds the similarities held at once
            parts = [self.probe(u[i : i + 2048], probes, margin) for i in range(0, len(u), 2048)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        c = u - self.mean
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
        s = c @ self.centroids.T - self.handicap
        r = min(probes, s.shape[1])
        top = np.argpartition(-s, r - 1, axis=1)[:, :r]
        v = np.take_along_axis(s, top, 1)
        order = np.lexsort((top, -v), axis=1)
        top, v = np.take_along_axis(top, order, 1), np.take_along_axis(v, order, 1)
        return top, v >= v[:, :1] - margin


@dataclass(frozen=True)
class Tree:
    """How rows are divided into cells, and the cells a row visits beside its own (``probes``, ``margin``)."""

    probes: int
    margin: float
    rows_per_cell: int = 1000
    fanout: int = 4096  # cells fitted at once, at most
    sample_per_cell: int = 16
    too_large: int = 16  # times ``rows_per_cell``: cells expected to hold more are divided again
    levels: int = 4
    salt_rows: int = 50_000  # rows of a large cell divided by one task
    rounds: int = 3
    evenness: float = 1.5

    @property
    def limit(self) -> int:
        return self.too_large * self.rows_per_cell

    def children(self, rows) -> np.ndarray:
        return np.clip(np.ceil(np.asarray(rows, np.float64) / self.rows_per_cell), 2, self.fanout).astype(np.int64)

    def rate(self, rows) -> np.ndarray:
        """The share of a cell's rows that its children are fitted on."""
        return np.minimum(1.0, self.sample_per_cell * self.children(rows) / np.maximum(rows, 1))

    def salts(self, rows) -> np.ndarray:
        return np.maximum(1, np.ceil(np.asarray(rows, np.float64) / self.salt_rows)).astype(np.int32)


def _lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(nearest, kind="stable")
        filled, first = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        norm = np.linalg.norm(sums, axis=1)
        good = norm > 1e-9
        c[filled[good]] = sums[good] / norm[good][:, None]
    return c


def _shares(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    best = [(s[i : i + 1024] - off).argmax(1) for i in range(0, len(s), 1024)]
    return np.bincount(np.concatenate(best), minlength=len(off)) / len(s)


def _handicap(s: np.ndarray, most: float, rounds: int = 40, step: float = 0.02) -> np.ndarray:
    """What to take off each centroid's similarities so that no cell holds more than a share ``most`` of the sample, as far as possible.

    Vectors without close relatives gather at the centroids nearest the mean; they are spread over their next best cells.
    """
    off = np.zeros(s.shape[1], np.float32)
    for _ in range(rounds):
        share = _shares(s, off)
        over = share > most
        if not over.any():
            break
        off[over] += step * np.log2(share[over] / most) + 0.002
    return off


def _arrivals(s: np.ndarray, off: np.ndarray, probes: int, margin: float) -> np.ndarray:
    """Per cell the share of the sample that goes there, at home or as a visitor."""
    out = np.zeros(len(off))
    r = min(probes, len(off))
    for i in range(0, len(s), 1024):
        v = s[i : i + 1024] - off
        top = np.argpartition(-v, r - 1, axis=1)[:, :r]
        best = np.take_along_axis(v, top, 1)
        out += np.bincount(top[best >= best.max(1, keepdims=True) - margin], minlength=len(off))
    return out / len(s)


def _fitted(x: np.ndarray, rows: float, cells: int, tree: Tree) -> Cells:
    """Cells for ``rows`` rows of which the unit rows ``x`` are a sample; equal rows count once, as copies travel together."""
    first = {r.tobytes(): i for i, r in reversed(list(enumerate(x)))}
    distinct = len(first) / len(x)
    if distinct < 1:
        x = x[np.sort(np.fromiter(first.values(), np.int64))]
    mean = x.mean(0, dtype=np.float64).astype(np.float32)
    x = x - mean
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    k = min(cells, max(1, len(x) // 2))
    c = _lloyd(x, k, tree.rounds, 5)
    x = x[:: -(-len(x) * k // (1 << 26))]
    s = np.concatenate([(x[i : i + 1024] @ c.T).astype(np.float16) for i in range(0, len(x), 1024)])  # at most 128 MB
    off = _handicap(s, tree.evenness / k)
    return Cells(mean, c, off, _arrivals(s, off, tree.probes, tree.margin) * rows * distinct)


CELLS_SCHEMA = "mean binary, c binary, off binary, expected binary"


def fit_cells(df: DataFrame, id_col: str, vec_col: str, dim: int, rows: int, tree: Tree) -> Cells | None:
    """Fit the top level of cells on a bounded sample; None if no row is usable.

    The sample is chosen by a hash of the id and holds about ``sample_per_cell`` rows per cell, so at most
    ``sample_per_cell * fanout`` (65,536) rows, fitted inside one task; only the centroids reach the driver.
    Every row is indexed afterwards. Cells above ``evenness`` times the mean size are handicapped.
    """
    cells = int(min(max(rows // tree.rows_per_cell, 8), tree.fanout))
    scale = 1 << 24
    wanted = min(scale, int(scale * cells * tree.sample_per_cell / max(rows, 1)) + 1)
    most = 2 * tree.sample_per_cell * tree.fanout
    picked = df.select(id_col, vec_col).where(F.col(id_col).isNotNull()).where(F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(scale)) < wanted).limit(most)

    def fit(batches):
        parts, ids = [np.zeros((0, dim), np.float32)], [np.zeros(0, np.int64)]
        for b in batches:
            at, m = matrix_of(b.column(1), dim)
            parts.append(unit(m))
            ids.append(b.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64))
        if sum(map(len, ids)):
            x = np.concatenate(parts)[np.unique(np.concatenate(ids), return_index=True)[1]]  # in order of id, so every run fits the same cells
            parts.clear()
            yield pa.RecordBatch.from_pydict(dict(zip(("mean", "c", "off", "expected"), ([v] for v in _fitted(x, rows, cells, tree).to_bytes()))))

    got = picked.mapInArrow(fit, CELLS_SCHEMA).collect()
    return Cells.restored(*map(bytes, got[0])) if got else None


PLACED = "cell long, home boolean, ids array<long>, vec binary, open boolean, expected double, salt int, pick boolean"


def _placed(own: Cells, tree: Tree, last: bool, parent: int, u: np.ndarray, home: np.ndarray, ids: pa.Array, vec: pa.Array) -> pa.RecordBatch:
    """The rows at the cells they go to, children of ``parent`` (-1: the top).

    Cells expected to be too large stay ``open``, to be divided; on the ``last`` level their rows go in pairs of blocks instead: a row
    belongs to the block its bytes select, each pair of blocks is a group of its own, so that a group holds two blocks at most
    and any two rows of the cell meet.
    """
    top, near = own.probe(u, tree.probes, tree.margin)
    r, j = np.nonzero(near)
    c = top[r, j]
    cell, own_home = (parent + 1) * tree.fanout + c, home[r] & (j == 0)
    expected = own.expected[c]
    large = expected > tree.limit
    hashed = np.fromiter((xxhash.xxh64_intdigest(v) for v in vec.to_pylist()), np.uint64, len(vec))[r]
    if last and large.any():
        blocks = np.where(large, np.ceil(2 * expected / tree.limit), 1).astype(np.int64)
        mine = (hashed % blocks.astype(np.uint64)).astype(np.int64)
        at = np.repeat(np.arange(len(r)), blocks)
        k = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        n, lo, hi = blocks[at], np.minimum(mine[at], k), np.maximum(mine[at], k)
        pair = lo * n - lo * (lo - 1) // 2 + hi - lo
        r, own_home, expected, hashed = r[at], own_home[at], expected[at], hashed[at]
        cell = np.where(n > 1, -((cell[at] << 20) + pair + 1), cell[at])
        large = np.zeros(len(r), bool)
    pick = large & ((hashed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / 2.0**53 < tree.rate(expected))
    salt = ((hashed >> np.uint64(7)) % tree.salts(expected).astype(np.uint64)).astype(np.int32)
    at = pa.array(r)
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(own_home), ids.take(at), vec.take(at), pa.array(large), pa.array(expected), pa.array(salt), pa.array(pick)], ["cell", "home", "ids", "vec", "open", "expected", "salt", "pick"])


def to_cells(df: DataFrame, id_col: str, vec_col: str, dim: int, cells: Cells, tree: Tree, last: bool = False) -> DataFrame:
    """One row per (vector, cell it goes to): its home cell, and as a visitor each further cell within the margin."""
    shared = df.sparkSession.sparkContext.broadcast(cells)

    def assign(batches):
        own = shared.value
        for b in batches:
            at, m = matrix_of(b.column(1), dim)
            ids_in = b.column(0).to_numpy(zero_copy_only=False)
            groups: dict[bytes, list[int]] = {}
            where: dict[bytes, int] = {}
            for pos, (i, key) in enumerate(zip(at, pack(m))):
                if key not in groups:
                    groups[key], where[key] = [], pos
                groups[key].append(int(ids_in[i]))
            if groups:
                keys = list(groups)
                yield _placed(own, tree, last, -1, unit(m[[where[k] for k in keys]]), np.ones(len(keys), bool), pa.array(list(groups.values()), pa.list_(pa.int64())), pa.array(keys, pa.binary()))

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null").mapInArrow(assign, PLACED)


def _divided(rows: DataFrame, dim: int, tree: Tree, last: bool) -> tuple[DataFrame, bool]:
    """The rows of open cells at the children of their cells, and whether some of these are open again.

    The children of a cell are fitted on a sample of its rows; they are a row of a table. The rows of a cell are spread over
    as many tasks as its size asks for, each of which reads the cell's children first and then the rows, one batch at a time.
    """

    def fit(t: pa.Table) -> pa.Table:
        vecs = sorted(set(t.column("vec").to_pylist()))  # whatever order the shuffle gave them
        size = t.column("expected")[0].as_py()
        got = _fitted(unit(unpack(vecs, dim)), size, int(tree.children(size)), tree)
        return pa.table({"cell": t.column("cell").slice(0, 1), "size": [size], "open": [bool((got.expected > tree.limit).any())], **dict(zip(("mean", "c", "off", "expected"), ([v] for v in got.to_bytes())))})

    models = rows.where("pick").select("cell", "vec", "expected").groupBy("cell").applyInArrow(fit, "cell long, size double, open boolean, " + CELLS_SCHEMA).checkpoint()
    salts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("size") / tree.salt_rows)).cast("int") - 1))
    first = models.select("cell", salts.alias("salt"), F.lit(0).alias("kind"), F.struct("mean", "c", "off", "expected").alias("model"), F.lit(None).cast("boolean").alias("home"), F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("vec"))
    data = rows.select("cell", "salt", F.lit(1).alias("kind"), F.lit(None).cast("struct<mean:binary,c:binary,off:binary,expected:binary>").alias("model"), "home", "ids", "vec")
    together = first.unionByName(data).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")

    def divide(batches):
        key, own = None, None
        for b in batches:
            cells, kinds = b.column(0).to_numpy(), b.column(2).to_numpy()
            cuts = np.nonzero(np.r_[True, (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1]) | (kinds[1:] == 0)])[0]
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows]):
                cell = int(cells[lo])
                if kinds[lo] == 0:
                    model = b.column(3)[lo].as_py()
                    key, own = cell, Cells.restored(model["mean"], model["c"], model["off"], model["expected"])
                    continue
                if key != cell:  # no row of it was in the sample: it stays one cell
                    key, own = cell, Cells(np.zeros(dim, np.float32), np.ones((1, dim), np.float32), np.zeros(1, np.float32), np.zeros(1))
                part = b.slice(lo, hi - lo)
                vec = part.column(6)
                yield _placed(own, tree, last, cell, unit(unpack(vec.to_pylist(), dim)), part.column(4).to_numpy(zero_copy_only=False).astype(bool), part.column(5), vec)

    return together.mapInArrow(divide, PLACED), not last and models.where("open").limit(1).count() > 0


def in_cells(df: DataFrame, id_col: str, vec_col: str, dim: int, rows: int, tree: Tree) -> DataFrame | None:
    """``(cell, home, ids, vec)``, brought together by cell, about one to a task (32 from 100,000 cells on); None if no row is usable.

    A tree of cells: the top level is fitted on the driver's behalf and broadcast (at most ``fanout`` centroids); cells to which
    more than ``limit`` rows go are divided again, by tables and shuffles only, until their parts are small enough or ``levels``
    are reached. So neither a large collection nor a crowd of near-copies makes a group larger than ``limit`` rows
    (as far as a sample of ``sample_per_cell`` rows a cell tells its size).
    """
    cells = fit_cells(df, id_col, vec_col, dim, rows, tree)
    if cells is None:
        return None
    columns = ["cell", "home", "ids", "vec"]
    more, level = bool((cells.expected > tree.limit).any()), 1
    placed = to_cells(df, id_col, vec_col, dim, cells, tree, last=tree.levels <= 1)
    total = len(cells.expected) + int(np.maximum(cells.expected - tree.limit, 0).sum() / tree.rows_per_cell)
    done = []
    while more and level < tree.levels:
        placed, level = placed.checkpoint(), level + 1
        done.append(placed.where("not open").select(*columns))
        placed, more = _divided(placed.where("open"), dim, tree, level == tree.levels)
    out = placed.select(*columns)
    for part in done:
        out = out.unionByName(part)
    return out.repartition(max(min(total, 4000), total // 32), "cell")


def merge_copies(table: pa.Table) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """The distinct vectors of a cell in order of their smallest id, whether each is at home there, and each one's ids, ascending."""
    slot: dict[bytes, int] = {}
    vecs: list[bytes] = []
    home: list[bool] = []
    ids: list[list] = []
    lists = table.column("ids").combine_chunks()
    flat, cuts = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    cuts = cuts - cuts[0]
    for h, a, b, v in zip(table.column("home").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), table.column("vec").to_pylist()):
        k = slot.setdefault(v, len(vecs))
        if k == len(vecs):
            vecs.append(v)
            home.append(h)
            ids.append([flat[a:b]])
        else:
            home[k] = home[k] or h
            ids[k].append(flat[a:b])
    own = [i[0] if len(i) == 1 and len(i[0]) == 1 else np.unique(np.concatenate(i)) for i in ids]
    order = sorted(range(len(vecs)), key=lambda k: int(own[k][0]))  # whatever order the shuffle gave them
    return [vecs[k] for k in order], np.array(home, bool)[order], [own[k] for k in order]
