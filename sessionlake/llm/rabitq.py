"""Embedding near-dedup with randomised-rotation binary codes.

Vectors are normalised and rotated by a random orthogonal matrix; the signs are the code, and the
inner product of code and vector is stored as correction factor.  For a query quantised to
`LEVELS` bits, bit planes and popcounts give an unbiased estimate of the inner product, and its
error is bounded by `SIGMAS` standard deviations of the residual; only pairs whose upper bound
reaches the threshold are computed again in double precision, and only these are linked.

Candidates come from cells of centroids fitted on a bounded sample; every vector is indexed.  A
vector lives in its nearest cell and queries each cell that a vector at the threshold angle may
fall into but for `SPILL` standard deviations of its direction; a pair is found if either side
queries the other's cell.  The tests measure recall against brute force.

Equal vectors are one class with a weight.  Cells are cut into chunks of members and queries, so
no task holds a whole hot cell, and a task emits counts and links to the first member of a local
component, not pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of other lengths never meet; repeated rows are separate vectors; a null id takes
part and is its own component if it reaches no other id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

COSINE = 0.95
LEVELS, SIGMAS, SPILL = 4, 4.0, 2.5
#: Vectors of the centroid sample at most (fewer for long vectors), members of a cell about, cells at most.
SAMPLE, CELL, CELLS = 16384, 800, 4096
#: Members and queries of one task.
MEMBERS, QUERIES = 2048, 8192


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of uint64 words."""
    words = -(-bits.shape[1] // 64)
    wide = np.zeros((len(bits), words * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64).reshape(len(bits), words)


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, inner product of each vector with its code's unit vector)."""
    v = unit @ turn.T
    return pack(v > 0), np.abs(v).sum(1) / math.sqrt(v.shape[1])


def estimates(query: np.ndarray, code: np.ndarray, factor: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products, error bounds) of unit queries with coded vectors: queries x vectors."""
    q = query @ turn.T
    dim = q.shape[1]
    low = q.min(1, keepdims=True)
    step = np.maximum((q.max(1, keepdims=True) - low) / (2**LEVELS - 1), 1e-12)
    # dithered rounding keeps the estimate unbiased
    level = np.floor((q - low) / step + np.random.default_rng(7).random(q.shape)).astype(np.int64).clip(0, 2**LEVELS - 1)
    dot = np.zeros((len(q), len(code)))
    for k in range(LEVELS):
        plane = pack((level >> k) & 1 == 1)
        for w in range(code.shape[1]):
            dot += (1 << k) * np.bitwise_count(plane[:, w][:, None] & code[:, w][None, :]).astype(np.float64)
    ones = np.bitwise_count(code).sum(1).astype(float)
    # <sign code, quantised query>: signs are 2 bit - 1
    signed = 2 * (low * ones[None, :] + step * dot) - (low * dim + step * level.sum(1, keepdims=True))
    about = signed / math.sqrt(dim) / factor[None, :]
    spread = np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1))
    rounding = step / 2 / factor[None, :]
    return about, SIGMAS * spread[None, :] + SIGMAS * rounding / math.sqrt(3) + 1e-9


def clusters(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means."""
    c = x[np.random.default_rng(0).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-30)[:, None], c)
    return c


def _valid(batches):
    for b in batches:
        lists = b.column(1)
        vecs, dims = [], []
        for x in lists.to_pylist():
            v = np.array([np.nan if y is None else y for y in x], float) if x else np.zeros(0)
            norm = np.linalg.norm(v) if len(v) and np.isfinite(v).all() else 0.0
            ok = np.isfinite(norm) and norm > 0
            vecs.append(C.blob(v) if ok else None)
            dims.append(len(v) if ok else 0)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], names=["vec_id", "dim", "vec"])


def _units(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(b"".join(raw), float).reshape(len(raw), -1)
    return v, v / np.linalg.norm(v, axis=1, keepdims=True)


_CODED = "uid bigint, weight bigint, dim int, home int, probes array<int>, code binary, factor double, vec binary"


def _coded(dim: int, centroids: np.ndarray):
    def run(batches):
        turn = rotation(dim)
        # how far the threshold angle may carry a vector along a direction, in SPILL standard deviations
        reach = SPILL * math.sqrt(1 - COSINE**2) / math.sqrt(dim)
        gap = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
        for b in batches:
            raw = b["vec"].to_pylist()
            if not raw:
                continue
            _, unit = _units(raw)
            code, factor = codes(unit, turn)
            near = unit @ centroids.T
            home = near.argmax(1)
            probe = near >= near.max(1, keepdims=True) - reach * gap[home]
            probe[np.arange(len(home)), home] = True
            bounds = np.append(0, np.cumsum(probe.sum(1))).astype(np.int32)
            probes = pa.ListArray.from_arrays(bounds, pa.array(np.nonzero(probe)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b["uid"], b["weight"], pa.array(np.full(len(raw), dim, np.int32)), pa.array(home.astype(np.int32)), probes, pa.array([C.blob(x) for x in code], pa.binary()), pa.array(factor), b["vec"]], names=[x.split()[0] for x in _CODED.split(", ")])

    return run


_FOUND = "uid bigint, links bigint, root bigint"


def _linked(table: pa.Table) -> pa.Table:
    """One task: the members of a chunk against queries; per vector its links (by weight) and the root of its local component."""
    member = np.asarray(table["member"])
    m, q = table.filter(pa.array(member)), table.filter(pa.array(~member))
    empty = pa.table({"uid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    if not m.num_rows or not q.num_rows:
        return empty
    dim = m["dim"][0].as_py()
    turn = rotation(dim)
    mu, qu = np.asarray(m["uid"]), np.asarray(q["uid"])
    mw, qw = np.asarray(m["weight"]), np.asarray(q["weight"])
    _, unit = _units(m["vec"].to_pylist())
    words = -(-dim // 64)
    code = np.frombuffer(b"".join(m["code"].to_pylist()), np.uint64).reshape(len(mu), words)
    factor = np.asarray(m["factor"])
    home = np.asarray(q["home"])
    asked = [set(x) for x in m["probes"].to_pylist()]
    _, query = _units(q["vec"].to_pylist())
    ml, ql = np.zeros(len(mu), np.int64), np.zeros(len(qu), np.int64)
    ids, at = np.unique(np.concatenate([mu, qu]), return_inverse=True)
    nm, nq = at[: len(mu)], at[len(mu) :]
    parent = np.arange(len(ids))

    for i in range(0, len(qu), 256):
        about, bound = estimates(query[i : i + 256], code, factor, turn)
        qa, ma = np.nonzero(about + bound >= COSINE)
        qa = qa + i
        own = qu[qa] != mu[ma]
        qa, ma = qa[own], ma[own]
        exact = np.concatenate([np.einsum("ij,ij->i", query[qa[k : k + 65536]], unit[ma[k : k + 65536]]) for k in range(0, len(qa), 65536)]) if len(qa) else np.zeros(0)
        hit = exact >= COSINE
        qa, ma = qa[hit], ma[hit]
        ql += np.bincount(qa, mw[ma], len(qu)).astype(np.int64)
        # the member counts the query only if it does not meet it again as a query of the query's cell
        again = np.array([int(home[a]) in asked[c] for a, c in zip(qa.tolist(), ma.tolist(), strict=True)], bool) if len(qa) else np.zeros(0, bool)
        ml += np.bincount(ma[~again], qw[qa[~again]], len(mu)).astype(np.int64)
        # unite the components that the links join; few are left after the first queries of a dense group
        pair = np.unique(parent[nq[qa]] * np.int64(len(ids)) + parent[nm[ma]])
        for x, y in zip((pair // len(ids)).tolist(), (pair % len(ids)).tolist(), strict=True):
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            parent[max(x, y)] = min(x, y)
        while (parent != parent[parent]).any():
            parent = parent[parent]
    uid, links = np.concatenate([mu, qu]), np.concatenate([ml, ql])
    root = ids[parent[at]]  # ids ascend, so a root is the smallest of its component
    keep = (links > 0) | (root != uid)
    return pa.table({"uid": uid[keep], "links": links[keep], "root": root[keep]})


def near_dedup(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = C.materialize(rows.mapInArrow(_valid, "vec_id bigint, dim int, vec binary").withColumn("uid", F.monotonically_increasing_id()), "vectors")
    classes = C.materialize(rows.where("dim > 0").groupBy("dim", "vec").agg(F.min("uid").alias("cid"), F.count("*").alias("weight")), "vector-classes")
    found = None
    for dim, n in sorted((r.dim, r.n) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()):  # one row per vector length
        part = _dimension(classes.where(F.col("dim") == dim).withColumnRenamed("cid", "uid"), dim, n)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = C.materialize(found, "found")
    links = found.groupBy("uid").agg(F.sum("links").alias("links")).withColumnRenamed("uid", "cid")
    roots = C.components(found.where("uid != root").select(F.col("uid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    own = classes.join(links, "cid", "left").join(roots, "cid", "left").select("dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    full = C.materialize(rows.join(own, ["dim", "vec"], "left").select("uid", "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("root", "uid").alias("root")), "linked")
    least = full.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return full.join(least, "root").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _dimension(classes: DataFrame, dim: int, n: int) -> DataFrame:
    bound = max(256, min(SAMPLE, (4 << 20) // dim))
    sample = classes.select("uid", "vec").orderBy(F.xxhash64("vec"), "uid").limit(bound).select("vec").toArrow()["vec"].to_pylist()
    _, unit = _units(sample)
    k = int(min(max(1, n // CELL), CELLS, len(unit)))
    coded = C.materialize(classes.mapInArrow(_coded(dim, clusters(unit, k)), _CODED), "codes")
    members = coded.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("mc"))
    asking = coded.select(F.explode("probes").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qc"))
    size = F.broadcast(members.join(asking, "cell"))  # at most CELLS rows
    cols = ["uid", "weight", "dim", "home", "probes", "code", "factor", "vec"]
    own = coded.withColumn("cell", F.col("home")).join(size, "cell")
    own = own.select("cell", F.expr("cast(pmod(xxhash64(uid), mc) as int)").alias("mi"), F.explode(F.expr("sequence(0, qc - 1)")).alias("qi"), F.lit(True).alias("member"), *cols)
    ask = coded.withColumn("cell", F.explode("probes")).join(size, "cell")
    ask = ask.select("cell", F.explode(F.expr("sequence(0, mc - 1)")).alias("mi"), F.expr("cast(pmod(xxhash64(uid, 1), qc) as int)").alias("qi"), F.lit(False).alias("member"), *cols)
    return own.unionByName(ask).groupBy("cell", "mi", "qi").applyInArrow(_linked, _FOUND)
