"""Maximum inner product search: anisotropic product quantisation, four-bit table scans, exact reranking and check.

Quantisation that serves ranking weighs the part of the residual that lies along the vector more than the rest (Guo et
al. 2020): for queries near a vector it is that part which shifts its score. Codes are chosen and centres are fitted for
that weighted loss. Scans add up table entries by code and only rank; scores are computed on the original vectors. How far
a score can be from what its code says is known for each vector, and what could be among the nearest by that is scored too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import stored

#: Vectors to fit the centres on: at most so many, those of least hash. All vectors are indexed.
FIT_ROWS = 10_000
#: Values in one code, centres for each code (four bits), rounds of fitting.
WIDTH, CENTRES, ROUNDS = 2, 16, 6
#: Of unit vectors, the inner product from which on errors along the vector count in full.
THRESHOLD = 0.2
#: Cells that a query looks into first, and candidates by code for each row asked for: both only set the score to beat.
FIRST_CELLS, SHORTLIST = 4, 4
#: Vectors in one cell on average, and cells at most.
CELL_ROWS, CELLS = 256, 1_024
#: Vectors in one block of the index, least and most, bytes of one, and blocks that a small table is cut into.
LEAST_BLOCK, BLOCK_ROWS, BLOCK_BYTES, BLOCKS = 1_024, 65_536, 32 << 20, 16
#: Codes that are scanned at a time.
SCAN_ROWS = 8_192


@dataclass
class Quantiser:
    centres: np.ndarray  # subspaces x CENTRES x WIDTH
    weight: float  # of the error along the vector, against 1 for the rest
    dim: int

    @staticmethod
    def fit(vectors: np.ndarray, threshold: float = THRESHOLD, rounds: int = ROUNDS, seed: int = 3) -> Quantiser:
        n, dim = vectors.shape
        padded = _pad(vectors)
        parts = padded.reshape(n, -1, WIDTH)
        rng = np.random.default_rng(seed)
        weight = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        centres = parts[rng.integers(0, n, CENTRES)].transpose(1, 0, 2).copy() + rng.normal(0, 1e-6, (parts.shape[1], CENTRES, WIDTH)) * np.abs(parts).max(0)[:, None]
        own = Quantiser(centres, weight, dim)
        for _ in range(4):  # plain k-means to begin with
            code = own._nearest(parts)
            for s in range(parts.shape[1]):
                for k in range(CENTRES):
                    if (here := code[:, s] == k).any():
                        own.centres[s, k] = parts[here, s].mean(0)
        unit = _units(padded).reshape(parts.shape)
        for _ in range(rounds):
            code = own.encode_padded(padded)
            error = parts - own.centres[np.arange(parts.shape[1]), code]
            along = (unit * error).sum((1, 2))
            for s in range(parts.shape[1]):
                u, x = unit[:, s], parts[:, s]
                rest = along - (u * error[:, s]).sum(1)
                for k in range(CENTRES):
                    here = code[:, s] == k
                    if not here.any():
                        continue
                    uk = u[here]
                    left = here.sum() * np.eye(WIDTH) + (weight - 1) * uk.T @ uk
                    pull = (uk * x[here]).sum(1) + rest[here]
                    own.centres[s, k] = np.linalg.solve(left, x[here].sum(0) + (weight - 1) * uk.T @ pull)
                error[:, s] = x - own.centres[s, code[:, s]]
                along = rest + (u * error[:, s]).sum(1)
        return own

    def _nearest(self, parts: np.ndarray) -> np.ndarray:
        code = np.empty(parts.shape[:2], np.int64)
        for s in range(parts.shape[1]):
            code[:, s] = ((parts[:, s, None] - self.centres[s]) ** 2).sum(2).argmin(1)
        return code

    def encode_padded(self, padded: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on |error|^2 + (weight - 1) (error along the vector)^2."""
        parts = padded.reshape(len(padded), -1, WIDTH)
        unit = _units(padded).reshape(parts.shape)
        code = self._nearest(parts)
        subspaces = np.arange(parts.shape[1])
        along = (unit * (parts - self.centres[subspaces, code])).sum(2)
        total = along.sum(1)
        for _ in range(sweeps):
            for s in range(parts.shape[1]):
                error = parts[:, s, None] - self.centres[s]
                own = (error * unit[:, s, None]).sum(2)
                other = total - along[:, s]
                loss = (error**2).sum(2) + (self.weight - 1) * (other[:, None] + own) ** 2
                code[:, s] = loss.argmin(1)
                along[:, s] = np.take_along_axis(own, code[:, s, None], 1)[:, 0]
                total = other + along[:, s]
        return code

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Two four-bit codes in each byte."""
        return self.encoded(vectors)[0]

    def encoded(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and of each vector how far at most the scan for a query of length one is from its inner product.

        That is the length of the error (Cauchy and Schwarz), and the rounding of the scan's sums and of the product.
        """
        padded = _pad(vectors)
        code = self.encode_padded(padded)
        back = self.centres[np.arange(len(self.centres)), code].reshape(padded.shape)
        rounding = (len(self.centres) + 8) * 2.0**-23
        off = (_lengths(padded - back) + rounding * _lengths(back)) * (1 + 1e-9) + 1e-9 * _lengths(padded) + 1e-30
        code = code.astype(np.uint8)
        return code[:, ::2] | code[:, 1::2] << 4, off

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For each byte of a code the inner product with what it stands for: bytes x 256."""
        parts = _pad(query[None])[0].reshape(-1, WIDTH)
        each = np.einsum("skw,sw->sk", self.centres, parts).astype(np.float32)
        return (each[1::2, :, None] + each[::2, None, :]).reshape(-1, CENTRES * CENTRES)


def _pad(vectors: np.ndarray) -> np.ndarray:
    """To whole pairs of subspaces."""
    return np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % (2 * WIDTH))))


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    """Of any size: squares neither overflow nor vanish."""
    most = np.maximum(np.abs(vectors).max(1), 1e-300)
    return most * np.linalg.norm(vectors / most[:, None], axis=1)


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double), each different row once, of the rows that take part.

    Left out are rows without an id and vectors that are null, empty, zero, or hold null, NaN or infinite components.
    """
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"))
    good = good.where(F.col("vec_id").isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0))
    return good.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0))).distinct()  # no negative zeros


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass
class Cells:
    """Directions that vectors are dealt to, and how long those of a cell are on average."""

    units: np.ndarray  # cells x dim
    length: np.ndarray
    lanes: np.ndarray  # of each cell, the lane of blocks that it is kept in

    @staticmethod
    def fit(vectors: np.ndarray, many: int, lanes: int, rounds: int = 8, seed: int = 9) -> Cells:
        """Spherical k-means. Lanes are stretches of cells along the line on which their directions vary most."""
        unit = _units(vectors)
        many = max(1, min(many, len(unit) // 8))
        centres = unit[np.random.default_rng(seed).choice(len(unit), many, replace=False)]
        for _ in range(rounds):
            near = (unit @ centres.T).argmax(1)
            total = np.zeros_like(centres)
            np.add.at(total, near, unit)
            held = np.linalg.norm(total, axis=1) > 1e-12
            centres[held] = _units(total[held])
        near = (unit @ centres.T).argmax(1)
        count = np.bincount(near, minlength=many)
        length = np.bincount(near, np.linalg.norm(vectors, axis=1), minlength=many) / np.maximum(count, 1)
        along = (centres - centres.mean(0)) @ np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
        order = np.argsort(along, kind="stable")
        lane = np.empty(many, np.int64)
        lane[order] = np.minimum((np.cumsum(count[order]) - count[order]) * lanes // max(1, count.sum()), lanes - 1)
        return Cells(centres, length, lane)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        return (_units(vectors) @ self.units.T).argmax(1)

    @property
    def middles(self) -> np.ndarray:
        return self.units * self.length[:, None]

    def away(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How far each vector is from the middle of its cell."""
        middles = self.middles[cells]
        return _lengths(vectors - middles) * (1 + 1e-9) + 1e-9 * _lengths(middles)

    def first(self, units: np.ndarray, many: int) -> np.ndarray:
        """Queries x cells: is the cell one of those to look into first?"""
        near = units @ self.middles.T
        if near.shape[1] <= many:
            return np.ones(near.shape, bool)
        out = np.zeros(near.shape, bool)
        np.put_along_axis(out, np.argpartition(-near, many, axis=1)[:, :many], True, 1)
        return out

    def can_hold(self, units: np.ndarray, least: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Queries x cells: can the cell hold a vector with an inner product of `least` or more?"""
        return ~(units @ self.middles.T + radius < least[:, None])


def search(rows: DataFrame, every: int = 20, k: int = 20, block_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query, which are the rows whose vec_id `every` divides.

    score is the inner product in double precision; nearest first, ties to the smaller vec_id; a query's own row (all
    rows of its id) is no candidate. Rows that repeat are one. A repeated id with several vectors counts once for each
    query, by its best score. Vectors of different lengths have no inner product: each length is searched on its own,
    and ranks count within it. Fewer candidates than k: all of them; no rows, no rows. Other columns are not read.

    Equal vectors are one class, which is indexed once; of its ids the k + 1 smallest can be among the nearest. Classes are
    dealt to cells of like directions, and cells to blocks; a query goes to blocks, has the codes of its cells there
    scanned, and the best by codes scored on the original vectors. That is done twice. First in the few cells that lie
    nearest: the k + 1 best scores found there set the score to beat. Then in all cells that can hold a vector of that score
    (by the middle of the cell and how far its vectors are from it), where each vector that can have that score (by its
    code and how far the vector is from it) is scored. So the result is exact on any rows; the fit only sets the work.
    """
    spark = rows.sparkSession
    good = stored(valid_vectors(rows).withColumn("dim", F.size("embedding")), "vectors")
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"  # as exact as given
    found = None
    for dim in sorted(r.dim for r in good.groupBy("dim").count().collect()):  # lengths are few: one a model
        part = _search(good.where(F.col("dim") == dim).drop("dim"), dim, kind, every, k, block_rows)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _best(scores: np.ndarray, owners: np.ndarray | None, n: int) -> np.ndarray:
    """Places of the n largest scores; with owners those of the n owners with the largest, n places each at most."""
    if owners is None:
        return np.argpartition(-scores, n)[:n] if len(scores) > n else np.arange(len(scores))
    order = np.lexsort((-scores, owners))
    new = np.diff(owners[order], prepend=owners[order[:1]] - 1) != 0
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    chosen = np.zeros(len(first), bool)
    chosen[_best(scores[order[first]], None, n)] = True
    return order[chosen[group] & (np.arange(len(order)) - first[group] < n)]


def _nearest(scores: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Places of the largest scores, ties to the smaller owner, down to the n-th different owner."""
    order = np.lexsort((owners, -scores))
    new = np.zeros(len(order), bool)
    new[np.unique(owners[order], return_index=True)[1]] = True
    return order[np.cumsum(new) <= n]


@dataclass
class Block:
    """Some vectors of a lane, cell after cell."""

    classes: np.ndarray
    owners: np.ndarray
    cells: np.ndarray
    off: np.ndarray  # how far scans are off at most
    codes: np.ndarray  # a row for each byte of a code
    vectors: np.ndarray

    @staticmethod
    def read(ids: bytes, off: bytes, codes: bytes, vectors: bytes, dim: int, kind: str) -> Block:
        classes, owners, cells = np.frombuffer(ids, "<i8").reshape(3, -1)
        packed = np.frombuffer(codes, np.uint8).reshape(len(classes), -1)
        return Block(classes, owners, cells, np.frombuffer(off, "<f8"), np.ascontiguousarray(packed.T), np.frombuffer(vectors, kind).reshape(-1, dim))

    def scan(self, table: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Table entries of the codes of the chosen vectors, added up."""
        codes = self.codes if len(chosen) == len(self.cells) else self.codes[:, chosen]
        score = np.zeros(codes.shape[1], np.float32)
        for i in range(0, len(score), SCAN_ROWS):
            part = score[i : i + SCAN_ROWS]
            for row, byte in zip(table, codes[:, i : i + SCAN_ROWS]):
                part += row[byte]
        return score

    def exact(self, chosen: np.ndarray, query: np.ndarray) -> np.ndarray:
        parts = [chosen[i : i + SCAN_ROWS] for i in range(0, len(chosen), SCAN_ROWS)]
        return np.concatenate([(self.vectors[p].astype(np.float64) * query).sum(1) for p in parts]) if parts else np.zeros(0)

    def nearest(self, query: np.ndarray, table: np.ndarray, unit: float, chosen: np.ndarray, least: float, n: int, repeats: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the n nearest owners' vectors among the chosen, of those with a score of `least` or more.

        unit: what an inner product with the query is to be divided by to be one of the scan.
        """
        owners = self.owners[chosen]
        near = self.scan(table, chosen)
        best = _best(near, owners if repeats else None, SHORTLIST * n)
        exact = self.exact(chosen[best], query)
        top = _nearest(exact, owners[best], n)
        if len(np.unique(owners[best][top])) == n:
            least = max(least, exact[top[-1]])
        look = ~(near + self.off[chosen] < least / unit)  # what the codes do not rule out
        look[best] = True
        look = chosen[look]
        exact = self.exact(look, query)
        look, exact = look[exact >= least], exact[exact >= least]
        top = _nearest(exact, self.owners[look], n)
        return look[top], exact[top]


BLOCK_SCHEMA = "lane int, query long, least double, vector binary, ids binary, off binary, codes binary, vectors binary"
BLOCK_COLUMNS = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]


def _index_blocks(index: DataFrame, lanes: DataFrame, rows_a_block: int) -> DataFrame:
    """Rows of BLOCK_SCHEMA, one a block. A lane with more rows than a block holds is dealt out to several.

    index: class, owner, lane, cell, off, codes, vector; lanes: lane, base, pieces: of each the number of its first block and
    how many it has."""

    def block(lane: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(held)
        ids = np.array([own.column(c).to_numpy() for c in ("class", "owner", "cell")]).astype("<i8").tobytes()
        off = own.column("off").to_numpy().astype("<f8").tobytes()
        codes, vectors = (b"".join(own.column(c).to_pylist()) for c in ("codes", "vector"))
        nulls = [pa.array([None], t) for t in (pa.int64(), pa.float64(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), *nulls, *[pa.array([x], pa.binary()) for x in (ids, off, codes, vectors)]], names=BLOCK_COLUMNS)

    def gather(batches):
        lane, held = None, []
        for batch in batches:
            number = batch.column(0).to_numpy()
            ends = np.flatnonzero(np.diff(number)) + 1
            for a, b in zip([0, *ends], [*ends, len(number)]):
                if held and number[a] != lane:
                    yield block(lane, held)
                    held = []
                lane = int(number[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield block(lane, held)

    piece = F.pmod(F.xxhash64("class"), F.col("pieces").cast("long"))
    rows = index.join(F.broadcast(lanes), "lane").select((F.col("base") + piece).cast("int").alias("lane"), "class", "owner", "cell", "off", "codes", "vector")
    return rows.repartition("lane").sortWithinPartitions("lane", "cell").mapInArrow(gather, BLOCK_SCHEMA)


def _search(good: DataFrame, dim: int, kind: str, every: int, k: int, block_rows: int | None) -> DataFrame:
    spark = good.sparkSession
    keyed = good.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    asked = F.max(F.col("vec_id") % every == 0).alias("asked")
    classes = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("owner"), F.any_value("embedding").alias("embedding"), asked)
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    n_queries = classes.where("asked").count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    repeats = classes.groupBy("owner").count().where("count > 1").limit(1).count() > 0  # an id with several vectors
    order = F.xxhash64("owner", "h1")

    if block_rows is None:
        block_rows = max(1, min(max(LEAST_BLOCK, total // BLOCKS), BLOCK_ROWS, BLOCK_BYTES // (np.dtype(kind).itemsize * dim)))
    share = min(1.0, 1.5 * FIT_ROWS / total)
    fitted = classes.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(order, "h1", "h2").limit(FIT_ROWS)
    vectors = np.array([r.embedding for r in fitted.select("embedding").collect()], np.float64)
    scale = 2.0 ** -np.clip(np.frexp(np.median(_lengths(vectors)))[1], -1000, 1000)  # of the index; scores are not scaled
    vectors *= scale
    cells = Cells.fit(vectors, min(CELLS, total // CELL_ROWS), -(-total // block_rows))
    quantiser, cells = spark.sparkContext.broadcast(Quantiser.fit(vectors)), spark.sparkContext.broadcast(cells)

    def pack(batches):
        for batch in batches:
            own = _matrix(batch.column(3), dim)
            scaled = own * scale
            cell = cells.value.of(scaled)
            codes, off = quantiser.value.encoded(scaled)
            extra = [pa.array(cells.value.lanes[cell].astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(cells.value.away(scaled, cell)), pa.array(off)]
            extra += [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in own.astype(kind)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *extra], names=["class", "owner", "asked", "lane", "cell", "away", "off", "codes", "vector"])

    index = classes.select("class", "owner", "asked", "embedding").mapInArrow(pack, "class long, owner long, asked boolean, lane int, cell int, away double, off double, codes binary, vector binary")
    index = stored(index, "index")
    radius = np.full(len(cells.value.length), -np.inf)  # of a cell without vectors
    for r in index.groupBy("cell").agg(F.max("away").alias("away")).collect():  # a row for each cell
        radius[r.cell] = r.away
    sizes = sorted((r.lane, r["count"]) for r in index.groupBy("lane").count().collect())  # a row for each lane
    pieces = [-(-n // block_rows) for _, n in sizes]
    bases = (np.cumsum(pieces) - pieces).tolist()
    lanes = spark.createDataFrame([(lane, b, p) for (lane, _), b, p in zip(sizes, bases, pieces)], "lane int, base int, pieces int")
    blocks = stored(_index_blocks(index, lanes, block_rows), "blocks")
    of_lane = {lane: range(b, b + p) for (lane, _), b, p in zip(sizes, bases, pieces)}
    blocks_of = [np.array(of_lane.get(int(lane), ()), np.int32) for lane in range(int(cells.value.lanes.max()) + 1)]

    def found(asking: DataFrame, first: bool) -> DataFrame:
        """query, class, owner, score: of each block the nearest in the cells that are first, or that can hold `least`.

        asking: class, vector, least.
        """

        def wanted(units: np.ndarray, least: np.ndarray) -> np.ndarray:
            return cells.value.first(units, FIRST_CELLS) if first else cells.value.can_hold(units, least, radius)

        def read(vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Queries, their directions, and by what inner products are divided to be those of the scan."""
            own = np.frombuffer(b"".join(vectors), kind).reshape(-1, dim).astype(np.float64)
            length = _lengths(own)
            return own, own / length[:, None], length / scale

        def ask(batches):
            """A row for each query and block in a lane of its cells."""
            for batch in batches:
                _, direction, unit = read(batch.column(1).to_pylist())
                near = wanted(direction, batch.column(2).to_numpy() / unit)
                meets = np.zeros((len(unit), len(blocks_of)), bool)
                np.logical_or.at(meets, (slice(None), cells.value.lanes), near)
                rows, at = np.nonzero(meets)
                parts = [blocks_of[lane] for lane in at]
                take = pa.array(np.repeat(rows, [len(p) for p in parts]))
                number = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                none = pa.nulls(len(take), pa.binary())
                own = [batch.column(i).take(take) for i in (0, 2, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), *own, none, none, none, none], names=BLOCK_COLUMNS)

        def scan(batches):
            lane, block = None, None
            for batch in batches:
                out = []
                for number, query_id, least, asking, *held in zip(*(c.to_pylist() for c in batch.columns)):
                    if asking is None:
                        lane, block = number, Block.read(*held, dim, kind)
                        continue
                    assert number == lane
                    query, direction, unit = read([asking])
                    chosen = np.flatnonzero(wanted(direction, np.array([least]) / unit)[0][block.cells])
                    if len(chosen):
                        top, exact = block.nearest(query[0], quantiser.value.tables(direction[0]), unit[0], chosen, least, k + 1, repeats)
                        out.append((np.full(len(top), query_id), block.classes[top], block.owners[top], exact))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(4)], names=["query", "class", "owner", "score"])

        # A block comes first in its lane and the queries after it, so a task holds one block and a batch of queries.
        meeting = blocks.unionByName(asking.mapInArrow(ask, BLOCK_SCHEMA))
        meeting = meeting.repartition(max(1, sum(pieces)), "lane").sortWithinPartitions("lane", F.col("ids").isNull())
        return meeting.mapInArrow(scan, "query long, class long, owner long, score double")

    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "owner")
    queries = index.where("asked").select("class", "vector")
    begun = found(queries.withColumn("least", F.lit(float("-inf"))), True).groupBy("query", "owner").agg(F.max("score").alias("score"))
    begun = begun.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1)
    beat = begun.groupBy(F.col("query").alias("class")).agg(F.min(F.when(F.col("place") == k + 1, F.col("score"))).alias("least"))
    asking = queries.join(beat, "class", "left").select("class", "vector", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    scored = found(stored(asking, "asking"), False)
    if not repeats:
        scored = scored.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1)
    return _ranked(scored.select("query", "class", "score"), keyed, classes, every, k)


def _ranked(scored: DataFrame, keyed: DataFrame, classes: DataFrame, every: int, k: int) -> DataFrame:
    """The k nearest ids of each query from its nearest classes and their exact scores."""
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    members = keyed.select("vec_id", "h1", "h2").withColumn("place", place).where(F.col("place") <= k + 1)
    members = members.join(classes.select("h1", "h2", "class"), ["h1", "h2"]).select("class", "vec_id")
    lists = scored.join(members, "class").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = [F.desc("score"), "vec_id"]
    lists = lists.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= k + 1)
    own = keyed.where(F.col("vec_id") % every == 0).join(classes.select("h1", "h2", F.col("class").alias("query")), ["h1", "h2"])
    out = own.select(F.col("vec_id").alias("query_id"), "query").join(lists.select("query", "vec_id", "score"), "query").where("vec_id <> query_id")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
