"""Problem 1: the most similar vectors for every vector.

Vectors are routed to shards by the nearest of a set of centroids that is
fitted on bounded samples; a shard is indexed by a hierarchical navigable
small-world graph in flat neighbour arrays (:mod:`lectern.llm.hnsw`), built and
searched where the shard lies.  A vector is stored in the shard of its nearest
centroid and also asked of the shards of the next nearest; the answers of all
shards are merged by a window over each vector's candidates.

No task holds an unbounded shard.  A cell with too many vectors is divided by
centroids of its own; vectors asked of a shard that many cells border on are
dealt out to blocks, each with its copy of the shard.  Ids of equal vectors are
one class: only its smallest id is routed, and the answers are expanded to the
others by joins at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import hnsw
from lectern.llm.hnsw import fit_centroids
from lectern.session import cut, drop_cut


def usable(vectors: DataFrame) -> DataFrame:
    """(id, dim, vector) of rows with an id whose vector is not null, has exactly
    ``dim`` finite numbers and is not all zero."""
    v = F.col("vector")
    good = F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return _sized(vectors).where(good)


def _sized(vectors: DataFrame) -> DataFrame:
    return vectors.where("id is not null and dim > 0 and size(vector) = dim").select("id", "dim", "vector")


def _by_dim(batch: pa.RecordBatch):
    """(dim, rows, vectors) of the usable vectors of a batch of sized ones."""
    dims, column = np.asarray(batch.column("dim")), batch.column("vector")
    for dim in np.unique(dims):
        at = np.nonzero(dims == dim)[0]
        part = column if len(at) == len(dims) else column.take(pa.array(at))
        x = np.asarray(part.flatten(), dtype=np.float32).reshape(len(at), int(dim))
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        yield int(dim), at[good], x[good]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float32).reshape(len(column), dim)


def _pack(rows: np.ndarray) -> list[bytes]:
    """Each row scaled by a power of two: as signed bytes where these hold it
    without loss, else in half precision as two compressed planes of bytes.  That
    is enough for ranks to 1e-3 of a cosine; a shuffle of plain floats would
    write twice to four times as much."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False).compress
    most = np.abs(rows).max(axis=1, keepdims=True)
    power = np.maximum(np.ceil(np.log2(np.where(most > 0, most, 1))), -120)
    whole = rows * np.exp2(6 - power)
    whole = np.where(np.abs(whole).max(axis=1, keepdims=True) * 2 <= 127, whole * 2, whole)
    exact = (whole == np.rint(whole)).all(1)
    out = np.empty(len(rows), dtype=object)
    out[exact] = [BYTES + r.tobytes() for r in whole[exact].astype(np.int8)]
    scaled = rows[~exact] * np.exp2(-power[~exact])
    planes = np.ascontiguousarray(scaled.astype(np.float16).view(np.uint8).reshape(len(scaled), rows.shape[1], 2).transpose(0, 2, 1))
    out[~exact] = [HALVES + squeeze(p.tobytes()) for p in planes]
    return out.tolist()


#: How a row is packed.
BYTES, HALVES = b"b", b"h"


def _unpack(packed: list[bytes], dim: int) -> np.ndarray:
    import zstandard

    loosen = zstandard.ZstdDecompressor().decompress
    out = np.empty((len(packed), dim), dtype=np.float16)
    exact = np.fromiter((p[:1] == BYTES for p in packed), dtype=bool, count=len(packed))
    out[exact] = np.frombuffer(b"".join(p[1:] for p in packed if p[:1] == BYTES), dtype=np.int8).reshape(-1, dim)
    planes = np.frombuffer(b"".join(loosen(p[1:]) for p in packed if p[:1] == HALVES), dtype=np.uint8).reshape(-1, 2, dim)
    out[~exact] = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.float16).reshape(-1, dim)
    return out


def _near(x: np.ndarray, centres: np.ndarray, probes: int, margin: float | None = None) -> np.ndarray:
    """The ``probes`` nearest centres of each row, best first; -1 for those
    further than ``margin`` (over the root of the size) behind the nearest."""
    if len(centres) == 1:
        return np.zeros((len(x), 1), np.int64)
    sims = hnsw.unit(x) @ centres.T
    probes = min(probes, len(centres))
    top = np.argpartition(-sims, probes - 1, axis=1)[:, :probes]
    got = np.take_along_axis(sims, top, 1)
    order = np.argsort(-got, axis=1, kind="stable")
    top, got = np.take_along_axis(top, order, 1), np.take_along_axis(got, order, 1)
    return top if margin is None else np.where(got >= got[:, :1] - margin / x.shape[1] ** 0.5, top, -1)


HOMES = "id string, dim int, class long, home int, guests array<int>"


def _homes(rows: DataFrame, centres: dict[int, np.ndarray], probes: int, margin: float | None = None) -> DataFrame:
    """(id, dim, class, home, guests) of usable vectors: the hash of the vector,
    the cell of its nearest centre and those of the next, of which it is asked."""
    shared = rows.sparkSession.sparkContext.broadcast((centres, probes, margin))

    def run(batches):
        import xxhash

        for batch in batches:
            ids = batch.column("id")
            for dim, at, x in _by_dim(batch):
                if dim in shared.value[0]:
                    near = _near(x, shared.value[0][dim], *shared.value[1:])
                    hashed = [xxhash.xxh64_intdigest(r) - (1 << 63) for r in x]
                    more = near[:, 1:].astype(np.int32)
                    guests = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((more >= 0).sum(1))]).astype(np.int32)), pa.array(more[more >= 0]))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), pa.array(hashed, pa.int64()), pa.array(near[:, 0].astype(np.int32)), guests], ["id", "dim", "class", "home", "guests"])

    return rows.mapInArrow(run, HOMES)


def _sample(sample: int, parts: int) -> int:
    """Vectors on which ``parts`` centroids are fitted: 32 each at least."""
    return max(sample, 32 * parts)


#: Centroids fitted at once; where more are wanted their cells are divided.
AT_ONCE = 1024


def _parts(rows: int, target: int, sample: int) -> tuple[int, float]:
    """The parts of a cell of so many rows and the share of these to look at."""
    parts = min(AT_ONCE, round(rows / target))
    return parts, min(1.0, 1.1 * _sample(sample, parts) / rows)


def _fit(rows: DataFrame, centres: dict[int, np.ndarray], parts: dict[tuple[int, int], tuple[int, float]], sample: int, seed: int) -> dict[int, np.ndarray]:
    """``centres`` with the cells of ``parts`` ((dim, cell) -> number of parts,
    share of its rows to look at) replaced by centroids fitted on at most
    :func:`_sample` vectors of the cell."""
    shared = rows.sparkSession.sparkContext.broadcast((centres, parts))

    def pick(batches):
        import xxhash

        centres, parts = shared.value
        for batch in batches:
            ids = batch.column("id")
            for dim, at, x in _by_dim(batch):
                if dim not in centres:
                    continue
                home = _near(x, centres[dim], 1)[:, 0]
                keep = [i for i, (h, y) in enumerate(zip(home.tolist(), ids.take(pa.array(at)).to_pylist())) if (dim, h) in parts and xxhash.xxh32_intdigest(y, seed) < parts[dim, h][1] * (1 << 32)]
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array([dim] * len(keep), pa.int32()), pa.array(home[keep].astype(np.int32)), pa.array(_pack(x[keep]), pa.binary())], ["dim", "cell", "data"])

    def fit(key, table):
        dim, cell = key[0].as_py(), key[1].as_py()
        wanted = shared.value[1][dim, cell][0]
        x = hnsw.unit(_unpack(table.column("data").to_pylist()[: _sample(sample, wanted)], dim))
        found = fit_centroids(x, wanted, seed=seed)
        return pa.table({"dim": pa.array([dim] * len(found), pa.int32()), "cell": pa.array([cell] * len(found), pa.int32()), "centre": pa.array([r.tobytes() for r in found], pa.binary())})

    got = rows.mapInArrow(pick, "dim int, cell int, data binary").groupBy("dim", "cell").applyInArrow(fit, "dim int, cell int, centre binary").collect()
    new = {}
    for dim, old in centres.items():
        divided = {c for d, c in parts if d == dim} & {r["cell"] for r in got if r["dim"] == dim}
        kept = [old[c] for c in range(len(old)) if c not in divided]
        new[dim] = np.stack(kept + [np.frombuffer(r["centre"], np.float32) for r in got if r["dim"] == dim]).astype(np.float32)
    return new


def most_similar(
    vectors: DataFrame, k: int = 10, min_cosine: float = -1.0, shard_rows: int = 4096, max_cells: int = 16_384, probes: int = 8, margin: float | None = 0.64, sample: int = 8192,
    degree: int = 8, width: int = 16, expand: int = 4, walk_dims: int | None = 64, few: int = 100_000, seed: int = 5,
) -> DataFrame:
    """(id, neighbour, cosine, rank): the ``k`` most similar other ids of each.

    ``vectors`` is (id, dim, vector); only vectors of equal ``dim`` are
    compared.  Unusable rows (see :func:`usable`) take no part, repeats of an id
    count once.  Ties of cosine go to the smaller id.  ``min_cosine`` drops
    answers below it.  Every vector is indexed and asked; ``sample`` vectors, or
    32 a centroid, fit the centroids of all, and as many those of a cell that is
    divided.

    The answers are approximate, by these means: a vector is asked of the shards
    whose centroids are within ``margin`` / sqrt(dim) of its nearest, ``probes``
    at most (of all these if null), since like vectors differ by about as much in
    their cosines with two centroids; the walks have a beam of ``width`` over graphs of ``degree``, walked in
    ``walk_dims`` random projections (all dimensions if null); what a walk finds
    is ranked by full vectors in half precision.  The links of what it found are
    looked at too, but only where its best cosine is within 0.15 of
    ``min_cosine``; a query further off seldom has an answer above it.

    A shard has ``shard_rows`` vectors on average and at most three times as
    many.  The more cells, the more often like vectors lie in different ones, so
    beyond 24 cells shards grow by the root of the vectors, to eight times as many;
    should that ask for more than ``max_cells`` centroids of a size of
    vectors, which every task gets, shards grow in proportion instead.  A cell
    whose vectors centroids cannot tell apart is divided by hash, and a vector
    is then asked in one part of it.  Classes of equal vectors are
    expanded by a broadcast if at most ``few`` ids are concerned, else by shuffles.
    """
    if probes < 1:
        raise ValueError("at least one shard is asked")
    spark, rows = vectors.sparkSession, _sized(vectors)
    sizes = {int(r[0]): r[1] for r in vectors.where("id is not null and dim > 0").groupBy("dim").count().collect()}
    target = {d: _target(n, shard_rows, max_cells) for d, n in sizes.items()}
    first = {(d, 0): _parts(n, target[d], sample) for d, n in sizes.items() if round(n / target[d]) > 1}
    centres = {d: np.zeros((1, d), np.float32) for d in sizes}
    if first:
        centres = _fit(rows, centres, first, sample, seed)
    for last in (False, False, True):
        homes = cut(_homes(rows, centres, probes, margin), "vector-homes")
        fill = {(r[0], r[1]): r[2] for r in homes.groupBy("dim", "home").count().collect()}
        big = {(d, c): _parts(m, target[d], sample) for (d, c), m in fill.items() if m > 3 * target[d]}
        if last or not big:
            break
        drop_cut(homes)
        centres = _fit(rows, centres, big, sample, seed)

    members = homes.select("dim", "class", "id").distinct()
    many = members.groupBy("dim", "class").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = cut(members.join(many, ["dim", "class"]).select("dim", "rep", "id"), "vector-copies")
    number = copies.count()
    of = F.broadcast if number <= few else lambda df: df
    if number:
        rows = rows.join(of(copies.where("id <> rep").select("id", "dim")), ["id", "dim"], "left_anti").select("id", "dim", "vector")
    asked = {(r[0], r[1]): r[2] for r in homes.select("dim", F.explode("guests").alias("guest")).groupBy("dim", "guest").count().collect()}
    found = _search(rows, centres, fill, asked, target, 6 * shard_rows, k, min_cosine, probes, margin, degree, width, expand, walk_dims, seed)
    if number:
        found = _expand(found, copies, of, k)
    # an id asked of several shards: its best answers of all
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.repartition("id").dropDuplicates(["id", "neighbour"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _target(rows: int, shard_rows: int, max_cells: int) -> int:
    """Vectors of a shard on average (see :func:`most_similar`)."""
    return max(shard_rows, min(8 * shard_rows, round((rows * shard_rows / 24) ** 0.5)), -(-rows // max_cells))


def _expand(found: DataFrame, copies: DataFrame, of, k: int) -> DataFrame:
    """Answers among the smallest ids of classes as answers among all ids:
    ``copies`` is (dim, rep, id) with every id of a class of two or more.  Of a
    class that is an answer, its ``k`` + 1 smallest ids can matter."""
    w = Window.partitionBy("dim", "rep").orderBy("id")
    some = copies.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).select(F.col("rep").alias("neighbour"), F.col("id").alias("copy"))
    wide = found.join(of(some), "neighbour", "left").select("id", F.coalesce("copy", "neighbour").alias("neighbour"), "cosine")
    every = copies.select("rep", F.col("id").alias("asking"))
    wide = wide.join(of(every), F.col("id") == F.col("rep"), "left").select(F.coalesce("asking", "id").alias("id"), "neighbour", "cosine")
    same = copies.select("rep", "id").join(of(some), F.col("rep") == F.col("neighbour")).where("id <> copy").select("id", F.col("copy").alias("neighbour"), F.lit(1.0).alias("cosine"))
    return wide.unionByName(same).where("id <> neighbour")


def _search(rows, centres, fill, asked, target, block, k, min_cosine, probes, margin, degree, width, expand, walk_dims, seed) -> DataFrame:
    """(id, neighbour, cosine) of all shards' answers.  ``fill`` and ``asked``
    count the vectors stored in a cell and asked of it from elsewhere; of these a
    block has ``block``, or twice the target, at most on average."""
    first, blocks, parts, shards = {}, {}, {}, 0
    for dim in sorted(centres):
        for c in range(len(centres[dim])):
            first[dim, c] = shards
            parts[dim, c] = -(-fill.get((dim, c), 0) // (3 * target[dim])) or 1
            blocks[dim, c] = max(1, -(-asked.get((dim, c), 0) // (max(block, 2 * target[dim]) * parts[dim, c])))
            shards += parts[dim, c] * blocks[dim, c]
    # larger graphs take a wider beam
    wide = {d: round(width * min(3.0, max(1.0, 6 * t / block) ** 0.5)) for d, t in target.items()}
    shared = rows.sparkSession.sparkContext.broadcast((centres, first, blocks, parts))

    def route(batches):
        import xxhash

        centres, first, blocks, parts = shared.value
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for dim, at, x in _by_dim(batch):
                shard, row, own = [], [], []
                for i, (n, cells) in enumerate(zip(at.tolist(), _near(x, centres[dim], probes, margin).tolist())):
                    h = xxhash.xxh64_intdigest(ids[n], dim)
                    if h in seen:
                        continue
                    seen.add(h)
                    home = (dim, cells[0])
                    part = first[home] + h % parts[home] * blocks[home]
                    for b in range(blocks[home]):
                        shard.append(part + b)
                        row.append(i)
                        own.append(1 if b else 2)
                    for c in cells[1:]:
                        if c < 0:
                            break
                        to = (dim, c)
                        shard.append(first[to] + h % (parts[to] * blocks[to]))
                        row.append(i)
                        own.append(0)
                take = np.asarray(row, np.int64)
                data = pa.array(_pack(x), pa.binary()).take(pa.array(take))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([dim] * len(row), pa.int32()), pa.array(own, pa.int8()), batch.column("id").take(pa.array(at[take])), data], ["shard", "dim", "own", "id", "data"])

    def search_shard(key, table):
        dim = table.column("dim")[0].as_py()
        ids = np.asarray(table.column("id").to_pylist(), dtype=object)
        project = None if walk_dims is None or walk_dims >= dim else np.random.default_rng(seed).standard_normal((dim, walk_dims)).astype(np.float32)
        return _answer(ids, np.asarray(table.column("own")), _unpack(table.column("data").to_pylist(), dim), k, min_cosine, degree, wide[dim], expand, project)

    routed = rows.mapInArrow(route, "shard int, dim int, own byte, id string, data binary")
    # about a shard a task, however large the tables are
    return routed.repartition(max(1, min(shards, 100_000)), "shard").groupBy("shard").applyInArrow(search_shard, "id string, neighbour string, cosine double")


def _widen(graph, full, queries, found, cos, least, width):
    """Look at the neighbours of what a walk found, by full vectors, for queries
    with an answer of at least ``least``: the walk itself is in projection."""
    b, w = found.shape
    out = np.full((b, max(w, width)), -1, dtype=np.int32)
    best = np.full(out.shape, -2.0, dtype=np.float32)
    out[:, :w], best[:, :w] = found, cos
    links, slot = graph.levels[0][1], graph.slots[0]
    strong = np.nonzero(cos.max(axis=1, initial=-2.0) >= least)[0] if b else np.zeros(0, int)
    for lo in range(0, len(strong), 128):
        at = strong[lo : lo + 128]
        mine = found[at]
        near = np.where(mine[:, :, None] >= 0, links[slot[np.maximum(mine, 0)]], -1).reshape(len(at), -1)
        ids = np.sort(np.concatenate([mine, near], axis=1), axis=1)
        fresh = ids >= 0
        fresh[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        r, c = np.nonzero(fresh)
        seen = np.full(ids.shape, -2.0, dtype=np.float32)
        seen[r, c] = np.einsum("ij,ij->i", full[ids[r, c]], queries[at[r]])
        keep = min(out.shape[1], ids.shape[1])
        top = np.argpartition(-seen, keep - 1, axis=1)[:, :keep]
        got = np.take_along_axis(seen, top, 1)
        out[at, :keep] = np.where(got > -2.0, np.take_along_axis(ids, top, 1), -1)
        best[at, :keep] = got
    return out, best


def _answer(ids, own, x, k, min_cosine, degree, width, expand, project) -> pa.Table:
    """Index the rows stored in the shard (``own`` is 1 or 2) and ask it for its
    own rows (2) and those from elsewhere (0)."""
    # one node for vectors equal in half precision, with its ids in order, repeats of an id once
    order = np.lexsort((ids.astype(str), own == 0))
    seen, mine, members, node_of, stored = set(), set(), [], {}, []
    asked: dict = {}
    for i in order:
        if ids[i] in seen:
            continue
        seen.add(ids[i])
        byte = x[i].tobytes()
        if own[i]:
            mine.add(ids[i]) if own[i] == 2 else None
            if byte not in node_of:
                node_of[byte] = len(members)
                members.append([])
                stored.append(i)
            members[node_of[byte]].append(ids[i])
        else:
            asked.setdefault(byte, []).append(ids[i])
    full = hnsw.unit(x[stored].astype(np.float32)) if stored else np.zeros((0, x.shape[1]), np.float32)
    out_id, out_near, out_cos = [], [], []
    if len(full):
        walk = full if project is None else hnsw.unit(full @ project)
        graph = hnsw.build(walk, degree, width, expand, full=full)
        foreign = [b for b in asked if b not in node_of]
        guests = hnsw.unit(np.frombuffer(b"".join(foreign), np.float16).reshape(len(foreign), -1).astype(np.float32)) if foreign else full[:0]
        here = np.asarray([i for i in range(len(full)) if not mine.isdisjoint(members[i]) or x[stored[i]].tobytes() in asked], dtype=np.int64)
        near, _ = hnsw.search(graph, walk[here], width, expand, own=here)
        far, _ = hnsw.search(graph, guests if project is None else hnsw.unit(guests @ project), width, expand, full=guests)
        homes = [[y for y in members[i] if y in mine] + asked.get(x[stored[i]].tobytes(), []) for i in here]
        for queries, found, who in ((full[here], near, homes), (guests, far, [asked[b] for b in foreign])):
            for lo in range(0, len(queries), 1024):
                f = found[lo : lo + 1024]
                cos = np.einsum("ijk,ik->ij", full[np.maximum(f, 0)], queries[lo : lo + 1024])
                cos = np.where(f >= 0, cos, -2.0)
                f, cos = _widen(graph, full, queries[lo : lo + 1024], f, cos, min_cosine - 0.15, 2 * k + 4)
                best = np.argsort(-cos, axis=1, kind="stable")
                cos, f = np.take_along_axis(cos, best, 1), np.take_along_axis(f, best, 1)
                count = (cos >= max(min_cosine, -1.5)).sum(1).tolist()
                for r, m in enumerate(count):
                    asking = who[lo + r]
                    if not m or (m == 1 and len(members[f[r, 0]]) == 1 and asking == members[f[r, 0]]):
                        continue
                    # nodes best first, equal ones by id; at most k + 1 ids of a node matter
                    rank = sorted((-round(float(c), 5), y) for c, node in zip(cos[r, :m], f[r, :m]) for y in members[node][: k + 1])
                    for q in asking:
                        got = 0
                        for c, y in rank:
                            if y == q:
                                continue
                            out_id.append(q)
                            out_near.append(y)
                            out_cos.append(min(1.0, -c))
                            got += 1
                            if got == k:
                                break
    return pa.table({"id": pa.array(out_id, pa.string()), "neighbour": pa.array(out_near, pa.string()), "cosine": pa.array(out_cos, pa.float64())})


def brute_force(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """Exact (id, neighbour, cosine, rank) of a bounded set of ``queries``
    against all ``vectors``, in blocks: the yardstick for the recall."""
    spark = vectors.sparkSession
    asked = usable(queries).dropDuplicates(["id"]).toPandas()
    shared = spark.sparkContext.broadcast({int(d): (g["id"].tolist(), hnsw.unit(np.stack(g["vector"].to_numpy()))) for d, g in asked.groupby("dim")})

    def run(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for d, (names, q) in shared.value.items():
                at = np.nonzero(dims == d)[0]
                if not len(at):
                    continue
                part = batch.take(pa.array(at))
                y = part.column("id").to_pylist()
                cos = hnsw.unit(_matrix(part.column("vector"), d)) @ q.T
                top = np.argsort(-cos, axis=0, kind="stable")[: k + 1]
                ids = [names[c] for c in range(len(names)) for _ in range(len(top))]
                near = [y[r] for c in range(len(names)) for r in top[:, c]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near), pa.array(np.take_along_axis(cos, top, 0).T.ravel().astype(np.float64))], ["id", "neighbour", "cosine"])

    found = usable(vectors).dropDuplicates(["id"]).mapInArrow(run, "id string, neighbour string, cosine double").where("id <> neighbour")
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def project_vectors(store: DataFrame) -> DataFrame:
    return store.select(F.col("payload.chunk_id").alias("id"), F.col("payload.dimensions").alias("dim"), F.col("payload.embedding").alias("vector"))


def similar_pairs(vectors: DataFrame, min_cosine: float = 0.65, **parameters) -> DataFrame:
    """(chunk_a, chunk_b): pairs of at least ``min_cosine`` of which one is among
    the most similar of the other; smaller id first."""
    found = most_similar(vectors, min_cosine=min_cosine, **parameters)
    return found.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()
