"""Distinct counts by set registers of a logarithmic base.

An identifier is hashed once: some bits choose one of ``m`` registers, the rest make a uniform number
u, and the register keeps the maximum of ``floor(1 - log_base(u))``. Registers of the same ``m`` and
base merge by maximum, across days, groups and partitions. A count is the maximum-likelihood rate of
the registers; union, intersection and Jaccard of two sets are the maximum of their joint likelihood.

A partial result is one row per group with its registers in one binary value: pairs of register and
level while few are used, else the levels of all registers. Rows are folded into such values before
anything is shuffled, so a group of any size sends at most ``2 * m`` bytes from each chunk of rows.

Stated error: the standard error of a count is at most ``relative_error(m, base)``; those of union,
intersection and Jaccard come from the curvature of the joint likelihood at its maximum.

Defined cases. Null and empty identifiers are none. Null group values form a group of their own; the
column ``grouping`` names the columns that a row is broken down by, so a null there is never a total.
Groups without identifiers have no row; repeated and redelivered rows change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

M, BASE = 2048, 1.2
BITS = 52
SEED = 7
#: Rows, and register entries, that a task folds at once.
HELD_ROWS, HELD_ENTRIES = 400_000, 1_000_000


def relative_error(m: int = M, base: float = BASE) -> float:
    return math.sqrt(((base + 1) / (base - 1) * math.log(base) - 1) / m)


def levels(base: float = BASE) -> int:
    return math.floor(1 + (BITS + 1) * math.log(2) / math.log(base)) + 1


def register(h: Column, m: int = M) -> Column:
    return F.pmod(h, F.lit(m)).cast("int")


def level(h: Column, base: float = BASE) -> Column:
    u = (F.shiftrightunsigned(h, 64 - BITS).cast("double") + 0.5) / float(2**BITS)
    return F.floor(1 - F.log(u) / math.log(base)).cast("int")


# ------------------------------------------------------------------------------------------ partial results


def entries(values: pa.ChunkedArray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and codes (register << 16 | level) of the registers used in a column of partial results, or of bare codes."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    if pa.types.is_integer(values.type):
        return np.arange(len(values)), values.to_numpy().astype(np.int64)
    size = pc.binary_length(values).to_numpy()
    first = np.frombuffer(values.buffers()[1], np.int32)[values.offset]
    data = np.frombuffer(values.buffers()[2], np.uint8)[first : first + int(size.sum())] if size.sum() else np.zeros(0, np.uint8)
    dense = size == 2 * m
    by_byte = np.repeat(dense, size)
    few = np.flatnonzero(~dense)
    row = np.repeat(few, size[few] // 4)
    code = data[~by_byte].view(np.uint32).astype(np.int64)
    if not dense.any():
        return row, code
    at, reg = np.nonzero(full := data[by_byte].view(np.uint16).reshape(-1, m))
    return np.r_[row, np.flatnonzero(dense)[at]], np.r_[code, reg.astype(np.int64) << 16 | full[at, reg]]


def group_ids(t: pa.Table, groups: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group, and the first row of each group."""
    ids = np.zeros(t.num_rows, np.int64)
    for g in groups:
        codes = pc.dictionary_encode(t.column(g).combine_chunks(), null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        ids = np.unique(ids * (len(codes.dictionary) + 1) + codes.indices.to_numpy(), return_inverse=True)[1]
    _, first, ids = np.unique(ids, return_index=True, return_inverse=True)
    return ids, first


def fold(t: pa.Table, groups: list[str], m: int) -> pa.Table:
    """One row per group: its registers merged by maximum."""
    ids, first = group_ids(t, groups)
    row, code = entries(t.column("registers"), m)
    x = np.sort(ids[row] << 32 | code)
    x = x[np.r_[x[1:] >> 16 != x[:-1] >> 16, np.ones(min(len(x), 1), bool)]]  # the highest level of each register
    of, code = x >> 32, x & 0xFFFFFFFF
    used = np.bincount(of, minlength=len(first))
    size = np.where(4 * used < 2 * m, 4 * used, 2 * m)
    ends = np.cumsum(size)
    out = np.zeros(int(size.sum()) // 4, np.uint32)
    begins, dense = ends - size, (size == 2 * m)[of]
    rank = np.arange(len(x)) - np.repeat(np.cumsum(used) - used, used)
    out[(begins[of] // 4 + rank)[~dense]] = code[~dense]
    out.view(np.uint16)[(begins[of] // 2 + (code >> 16))[dense]] = code[dense] & 0xFFFF
    registers = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(out)])
    return t.select(groups).take(pa.array(first)).append_column("registers", registers)


def folding(groups: list[str], m: int, ordered: bool, then: Callable[[pa.Table], Iterator[pa.Table]] | None = None):
    """Kernel that folds rows chunk by chunk; ``ordered``: rows of a group are successive and become one row in all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        load = 0

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, load
            t = fold(pa.concat_tables(held).combine_chunks(), groups, m)
            held, load = [], 0
            if ordered and not last:
                # the group of the last row may go on
                end = pa.concat_tables([t, tail]) if (tail := self_tail[0]) is not None else t
                ids, _ = group_ids(end, groups)
                go_on = ids[: t.num_rows] == ids[-1]
                held = [t.filter(pa.array(go_on))]
                t = t.filter(pa.array(~go_on))
            for x in then(t) if then and t.num_rows else [t]:
                yield from x.to_batches()

        self_tail: list[pa.Table | None] = [None]
        for b in batches:
            if not b.num_rows:
                continue
            x = pa.Table.from_batches([b]).select([*groups, "registers"])
            held.append(x)
            load += b.num_rows if pa.types.is_integer(x.schema.field("registers").type) else b.num_rows + b.column("registers").nbytes // 4
            if load >= (HELD_ENTRIES if ordered else HELD_ROWS):
                self_tail[0] = x.slice(x.num_rows - 1)
                yield from emit(False)
        if held:
            yield from emit(True)

    return run


def schema_of(df: DataFrame, groups: list[str]) -> str:
    return ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups) + ", registers binary"


def registers(rows: DataFrame, groups: list[str], hashed: str, m: int = M, base: float = BASE) -> DataFrame:
    """Partial results: one row per group. ``hashed`` is a 64-bit hash; null is skipped."""
    return merge(coded(rows, groups, hashed, m, base).mapInArrow(folding(groups, m, False), schema_of(rows, groups)), groups, m)


def merge(partials: DataFrame, groups: list[str], m: int = M, then: Callable[[pa.Table], Iterator[pa.Table]] | None = None, schema: str | None = None) -> DataFrame:
    """Partial results of finer or repeated groups merged to one row per group of ``groups``."""
    apart = partials.select(*groups, "registers").repartition(*groups).sortWithinPartitions(*groups)
    return apart.mapInArrow(folding(groups, m, True, then), schema or schema_of(partials, groups))


def rate(counts: np.ndarray, base: float = BASE) -> np.ndarray:
    """Maximum-likelihood identifiers per register from counts (sets x levels, level 0 = unused)."""
    k = np.arange(counts.shape[1])
    low = base ** -k.astype(float)
    step = low[1:] * (base - 1)
    fixed = counts @ low
    c = counts[:, 1:]
    lo, hi = np.full(len(counts), 1e-12), np.full(len(counts), base ** (counts.shape[1] + 2.0))
    for _ in range(44):
        mid = np.sqrt(lo * hi)
        with np.errstate(over="ignore"):
            slope = (c * (step / np.expm1(np.minimum(mid[:, None] * step, 700.0)))).sum(1) - fixed
        up = slope > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return np.where(c.sum(1) > 0, np.sqrt(lo * hi), 0.0)


def count_matrix(row: np.ndarray, code: np.ndarray, n: int, m: int, base: float) -> np.ndarray:
    """Registers of each level per row; level 0 are those that are not used."""
    width = levels(base) + 1
    out = np.bincount(row * width + (code & 0xFFFF), minlength=n * width).reshape(n, width).astype(float)
    out[:, 0] = m - out[:, 1:].sum(1)
    return out


def estimating(m: int, base: float) -> Callable[[pa.Table], Iterator[pa.Table]]:
    e = relative_error(m, base)

    def run(t: pa.Table) -> Iterator[pa.Table]:
        for x in (t.slice(i, 2000) for i in range(0, t.num_rows, 2000)):
            n = rate(count_matrix(*entries(x.column("registers"), m), x.num_rows, m, base), base) * m
            x = x.drop_columns("registers")
            for name, v in (("distinct_estimate", n), ("low", n * (1 - 2 * e)), ("high", n * (1 + 2 * e)), ("relative_error", np.full(len(n), e))):
                x = x.append_column(name, pa.array(v))
            yield x

    return run


ESTIMATES = "distinct_estimate double, low double, high double, relative_error double"


def estimates(partials: DataFrame, groups: list[str], m: int = M, base: float = BASE) -> DataFrame:
    """Estimated count per group, of all its partial results, with the bounds of twice the stated error."""
    return merge(partials, groups, m, estimating(m, base), schema_of(partials, groups).replace("registers binary", ESTIMATES))


def groupings(coded: DataFrame, dims: list[str], keys: list[str], m: int = M) -> DataFrame:
    """Partial results for every combination of ``dims`` (kept apart by ``keys``), several per coarse group.

    A task that has merged the finest groups folds them into all coarser ones at once, chunk by chunk,
    so one shuffle of these partial results is all that coarser groups need.
    """
    every = [*keys, *dims]

    def coarser(t: pa.Table) -> Iterator[pa.Table]:
        for size in range(len(dims), -1, -1):
            for names in combinations(dims, size):
                x = fold(t, [*keys, *names], m) if size < len(dims) else t
                absent = {d: pa.nulls(x.num_rows, t.schema.field(d).type) for d in dims if d not in names}
                cols = {k: absent[k] if k in absent else x.column(k) for k in every}
                yield pa.table({"grouping": pa.array([",".join(names)] * x.num_rows, pa.string())} | cols | {"registers": x.column("registers")})

    finest = coded.mapInArrow(folding(every, m, False), schema_of(coded, every))
    return merge(finest, every, m, coarser, f"grouping string, {schema_of(coded, every)}")


def identifiers(log: DataFrame) -> DataFrame:
    """Rows of label_log as (day, tenant, cluster, kind, h): series under ``series_id``, values under ``label:name``."""
    value = F.when(F.length("label_value") > 0, F.xxhash64("label_value", F.lit(SEED)))
    each = F.array(F.struct(F.lit("series_id").alias("kind"), F.when(F.col("series_id").isNotNull(), F.xxhash64("series_id", F.lit(SEED))).alias("h")), F.struct(F.concat(F.lit("label:"), "label_name").alias("kind"), value.alias("h")))
    return log.select(F.date_format("seen_at", "yyyy-MM-dd").alias("day"), "tenant", "cluster", F.explode(each).alias("x")).select("day", "tenant", "cluster", "x.kind", "x.h").where("kind is not null")


def coded(rows: DataFrame, groups: list[str], hashed: str, m: int, base: float) -> DataFrame:
    h = F.col(hashed)
    return rows.where(h.isNotNull()).select(*groups, (register(h, m) * 65536 + level(h, base)).alias("registers"))


def distinct_counts(log: DataFrame, m: int = M, base: float = BASE) -> DataFrame:
    """Distinct series and label values per day, tenant, cluster and every combination of them."""
    dims = ["day", "tenant", "cluster"]
    every = groupings(coded(identifiers(log), ["kind", *dims], "h", m, base), dims, ["kind"], m)
    return estimates(every, ["kind", "grouping", *dims], m, base)


# ------------------------------------------------------------------------------------------------ two sets


class Joint:
    """Joint log-likelihood of aligned register pairs, as a function of the rates of only-left, only-right and shared."""

    def __init__(self, x: np.ndarray, y: np.ndarray, base: float):
        width = levels(base) + 1
        pairs, self.w = np.unique(x.astype(int) * width + y.astype(int), return_counts=True)
        i, j = pairs // width, pairs % width
        low = base ** -np.arange(width).astype(float)
        self.levels = low
        self.corners = [(np.maximum(p, 0), np.maximum(q, 0), np.maximum(np.minimum(p, q), 0), sign * ((p >= 0) & (q >= 0))) for p, q, sign in ((i, j, 1.0), (i - 1, j, -1.0), (i, j - 1, -1.0), (i - 1, j - 1, 1.0))]

    def __call__(self, a: float, b: float, c: float) -> float:
        fa, fb, fc = np.exp(-a * self.levels), np.exp(-b * self.levels), np.exp(-c * self.levels)
        p = sum(sign * fa[i] * fb[j] * fc[k] for i, j, k, sign in self.corners)
        return float(self.w @ np.log(np.maximum(p, 1e-300)))


def highest(f, lo: float, hi: float, rounds: int) -> float:
    """Golden-section search for the maximum of a one-peaked function."""
    g = (math.sqrt(5) - 1) / 2
    p, q = hi - g * (hi - lo), lo + g * (hi - lo)
    fp, fq = f(p), f(q)
    for _ in range(rounds):
        if fp >= fq:
            hi, q, fq = q, p, fp
            p = hi - g * (hi - lo)
            fp = f(p)
        else:
            lo, p, fp = p, q, fq
            q = lo + g * (hi - lo)
            fq = f(q)
    return (lo + hi) / 2


def joint_rates(x: np.ndarray, y: np.ndarray, base: float = BASE) -> tuple[float, float, float]:
    """Maximum-likelihood rates (only left, only right, shared) of two aligned register arrays, 0 = unused."""
    width = levels(base) + 1
    f = Joint(x, y, base)
    ra, rb = rate(np.stack([np.bincount(v.astype(int), minlength=width) for v in (x, y)]).astype(float), base)
    tiny = 1e-12
    # along the margins first, then from there to the joint maximum, a rate at a time
    c = highest(lambda s: f(max(ra - s, tiny), max(rb - s, tiny), s), 0.0, min(ra, rb), 24)
    a, b = max(ra - c, tiny), max(rb - c, tiny)
    for _ in range(2):
        da, db, dc = (0.1 * v + 0.02 * (v + c) for v in (a, b, c))
        a = highest(lambda s: f(s, b, c), max(a - da, 0.0), a + da, 12)
        b = highest(lambda s: f(a, s, c), max(b - db, 0.0), b + db, 12)
        c = highest(lambda s: f(a, b, s), max(c - dc, 0.0), c + dc, 12)
    return a, b, c


def joint_errors(x: np.ndarray, y: np.ndarray, rates: tuple[float, float, float], base: float = BASE) -> tuple[float, float, float]:
    """Standard errors of union and shared rates and of Jaccard, from the curvature of the joint likelihood.

    A rate at its border 0 has no curvature to either side; its error is where the log-likelihood has fallen by 1/2.
    """
    f, p = Joint(x, y, base), np.array(rates)
    total = p.sum()
    step = np.maximum(0.05 * p, 0.001 * total)
    inner = np.flatnonzero(p > step)
    cov = np.zeros((3, 3))
    if len(inner):
        ways, size = np.eye(3)[inner] * step, step[inner]
        up = [[f(*(p + d + e)) for e in ways] for d in ways]
        down = [[f(*(p - d - e)) if (p - d - e > 0).all() else None for e in ways] for d in ways]
        one = [(f(*(p + d)), f(*(p - d))) for d in ways]
        top = f(*p)
        curve = np.empty((len(inner), len(inner)))
        for i in range(len(inner)):
            for j in range(len(inner)):
                ahead = up[i][j] - one[i][0] - one[j][0] + top
                behind = ahead if down[i][j] is None else down[i][j] - one[i][1] - one[j][1] + top
                curve[i, j] = -(one[i][0] - 2 * top + one[i][1]) / size[i] ** 2 if i == j else -(ahead + behind) / (2 * size[i] * size[j])
        value, vectors = np.linalg.eigh(curve)
        cov[np.ix_(inner, inner)] = (vectors / np.maximum(value, 1e-4 * max(value.max(), 1e-300))) @ vectors.T
    for i in set(range(3)) - set(inner.tolist()):
        way, lo, hi, least = np.eye(3)[i], 0.0, 0.01 * total, f(*p) - 0.5
        while hi < total and f(*(p + way * hi)) > least:
            lo, hi = hi, 2 * hi
        for _ in range(12):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(*(p + way * mid)) > least else (lo, mid)
        cov[i, i] = hi**2
    ways = np.ones(3), np.array([0.0, 0.0, 1.0]), (np.array([0.0, 0.0, 1.0]) * total - p[2]) / total**2
    return tuple(float(np.sqrt(max(w @ cov @ w, 0.0))) for w in ways)


OVERLAP = "union_estimate double, intersection_estimate double, jaccard_estimate double, union_error double, intersection_error double, jaccard_error double"


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], m: int = M, base: float = BASE) -> DataFrame:
    """Union, intersection and Jaccard of the sets that two tables of whole partial results hold under the same keys, with standard errors."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = left.alias("l").join(right.alias("r"), same).select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.registers").alias("registers_l"), F.col("r.registers").alias("registers_r"))
    schema = ", ".join(f"`{k}` {both.schema[k].dataType.simpleString()}" for k in keys) + ", " + OVERLAP

    def levels_of(column: pa.Array) -> list[np.ndarray]:
        row, code = entries(column, m)
        out = np.zeros((len(column), m), np.int64)
        out[row, code >> 16] = code & 0xFFFF
        return list(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
                out = []
                for x, y in zip(levels_of(b.column("registers_l")), levels_of(b.column("registers_r"))):
                    rates = joint_rates(x, y, base)
                    total, shared = sum(rates), rates[2]
                    u, i, j = joint_errors(x, y, rates, base)
                    out.append((m * total, m * shared, shared / total, m * u, m * i, max(j, 1 / m)))
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], *[pa.array(c, pa.float64()) for c in zip(*out)]], [*keys, *[c.split()[0] for c in OVERLAP.split(", ")]])

    return both.mapInArrow(run, schema)


def next_day_overlap(log: DataFrame, m: int = M, base: float = BASE) -> DataFrame:
    """For each kind and tenant: how much of a day's set comes back on the next day."""
    days = registers(identifiers(log), ["kind", "tenant", "day"], "h", m, base)
    before = days.withColumn("day", F.date_format(F.date_sub(F.to_date("day"), 1), "yyyy-MM-dd"))
    return overlaps(days, before, ["kind", "tenant", "day"], m, base)


def cluster_overlap(log: DataFrame, m: int = M, base: float = BASE) -> DataFrame:
    """For each kind and tenant: what a cluster's set shares with that of the next cluster in order of names."""
    sets = registers(identifiers(log), ["kind", "tenant", "cluster"], "h", m, base)
    follows = sets.select("kind", "tenant", "cluster").withColumn("next_cluster", F.lead("cluster").over(Window.partitionBy("kind", "tenant").orderBy("cluster"))).where("next_cluster is not null")
    a, b = sets.alias("a"), follows.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("kind", "tenant")]
    left = a.join(b, [*on, F.col("a.cluster").eqNullSafe(F.col("b.cluster"))]).select("b.*", "a.registers")
    right = a.join(b, [*on, F.col("a.cluster") == F.col("b.next_cluster")]).select("b.*", "a.registers")
    return overlaps(left, right, ["kind", "tenant", "cluster", "next_cluster"], m, base)
