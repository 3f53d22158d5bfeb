"""Product codes of vectors: Lloyd's rounds over integer parts, with Hamerly's bounds.

Components become integers (floor of 4096 times the component) and each vector is cut
into equal parts; every part position has a codebook. A table holds, for each vector,
its integers, its codes and two bounds for each part: how far its entry is at most, and
how far any other entry is at least. When a codebook has moved, the bounds move with
it, and only parts whose upper bound doesn't stay strictly below the lower one (or
below half the way to the next entry) are scanned again. Bounds are stored as floats
rounded outwards, scans are integer sums, so codes are those of a full scan: of equal
distances the lower index wins, since equal distances never hold strictly.

One job a round: its tasks write the new codes and bounds and one row with the sums of
the parts of each entry. These are summed by Spark; only a codebook (parts x entries x
width numbers) comes to the driver and goes to the tasks.

Vectors that are null or hold a null or non-finite component are dropped. Shorter
vectors are filled with zeros up to the longest, and all up to a multiple of the
parts. Integers end at +-2^26 (components of 16,384), so that distances are exact. With
fewer vectors than entries a codebook has as many entries as there are vectors; null
ids come last and of rows with one id the smaller integers come first. Repeated rows
count each. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._shared import looked_up, mark, sweep, table, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Integers end here.
LARGEST = 1 << 26
#: Integers compared at once in a scan.
SCAN = 1 << 20


def _integers(vectors: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Rows whose vector can be used, and their integers as bytes."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten()
    lengths = np.where(vectors.is_valid(), vectors.value_lengths().fill_null(0), 0).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = np.flatnonzero(np.asarray(vectors.is_valid()) & (bad[at[1:]] == bad[at[:-1]]))
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.clip(np.floor(np.nan_to_num(values) * SCALE), -LARGEST, LARGEST).astype("<i4")
    return good, [whole[at[i] : at[i + 1]].tobytes() for i in good]


def _matrix(v: pa.Array, parts: int, width: int) -> np.ndarray:
    """Integers of a batch as rows x parts x width."""
    size = parts * width * 4
    rows = v.to_pylist()
    return np.frombuffer(b"".join(x.ljust(size, b"\0") for x in rows), "<i4").reshape(len(rows), parts, width).astype(np.int64)


def _scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row (the lower index of equals), its squared distance and that of the next nearest (-1: none)."""
    best, first, second = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.full(len(x), -1, np.int64)
    step = max(1, SCAN // max(1, book.size))
    for k in range(0, len(x), step):
        d = ((x[k : k + step, None, :] - book[None]) ** 2).sum(-1)
        at = d.argmin(1)
        rows = np.arange(len(d))
        best[k : k + step], first[k : k + step] = at, d[rows, at]
        if len(book) > 1:
            d[rows, at] = np.iinfo(np.int64).max
            second[k : k + step] = d.min(1)
    return best, first, second


def _up(x: np.ndarray) -> np.ndarray:
    """As a float of 32 bits, not less."""
    return np.nextafter(np.nextafter(x, np.inf).astype("<f4"), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, -np.inf).astype("<f4"), np.float32(-np.inf))


def _floor(second: np.ndarray) -> np.ndarray:
    """Lower bound of the distance to any other entry."""
    return _down(np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0).astype(np.float64))))


class Step:
    """Codes under ``books`` from those under ``before`` (None: no codes yet). Books: parts x entries x width."""

    def __init__(self, before: np.ndarray | None, books: np.ndarray) -> None:
        self.books, self.first = books, before is None
        if before is not None:
            moved = _up(np.sqrt(((books - before) ** 2).sum(-1).astype(np.float64)))
            self.moved = moved
            parts, k = moved.shape
            others = np.where(np.eye(k, dtype=bool)[None], np.float32(0), moved[:, None, :])
            self.others = others.max(-1)  # the most that any other entry has moved
            apart = ((books[:, :, None, :] - books[:, None, :, :]) ** 2).sum(-1).astype(np.float64)
            apart[:, np.arange(k), np.arange(k)] = np.inf
            self.half = _down(np.sqrt(apart.min(-1)) / 2)

    def __call__(self, x: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Bring codes and bounds up to date in place; the number of parts that were scanned."""
        scanned = 0
        for p in range(x.shape[1]):
            if self.first:
                todo = np.arange(len(x))
            else:
                a = codes[:, p]
                upper[:, p] = _up(upper[:, p].astype(np.float64) + self.moved[p, a])
                lower[:, p] = _down(lower[:, p].astype(np.float64) - self.others[p, a])
                limit = np.maximum(lower[:, p], self.half[p, a])
                todo = np.flatnonzero(~(upper[:, p] < limit))
                exact = ((x[todo, p] - self.books[p, a[todo]]) ** 2).sum(-1)
                upper[todo, p] = _up(np.sqrt(exact.astype(np.float64)))
                todo = todo[~(upper[todo, p] < limit[todo])]
            if len(todo):
                best, near, second = _scan(x[todo, p], self.books[p])
                codes[todo, p] = best
                upper[todo, p], lower[todo, p] = _up(np.sqrt(near.astype(np.float64))), _floor(second)
                scanned += len(todo)
        return scanned


def _read(batch: pa.RecordBatch, parts: int, width: int, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = _matrix(batch["v"], parts, width)
    n = len(x)
    if first:
        return x, np.zeros((n, parts), np.uint8), np.zeros((n, parts), "<f4"), np.zeros((n, parts), "<f4")
    each = lambda name, kind: np.frombuffer(b"".join(batch[name].to_pylist()), kind).reshape(n, parts).copy()
    return x, each("codes", np.uint8), each("upper", "<f4"), each("lower", "<f4")


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _round(step: Step, kind: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = step.books.shape
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes, upper, lower = _read(batch, parts, width, step.first)
            step(x, codes, upper, lower)
            for p in range(parts):
                for k in np.unique(codes[:, p]):
                    own = x[codes[:, p] == k, p]
                    sums[p, k, :width] += own.sum(0)
                    sums[p, k, width] += len(own)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["v"], _bytes(codes), _bytes(upper), _bytes(lower), pa.nulls(len(x), pa.list_(pa.int64())), pa.array(["vector"] * len(x))], schema=kind)
        if sums[..., width].any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in list(kind)[:6]] + [pa.array([sums.ravel()], pa.list_(pa.int64())), pa.array(["sums"])], schema=kind)

    return run


def _last(step: Step, kind: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = step.books.shape
        for batch in batches:
            x, codes, upper, lower = _read(batch, parts, width, step.first)
            step(x, codes, upper, lower)
            error = sum(((x[:, p] - step.books[p, codes[:, p]]) ** 2).sum(-1) for p in range(parts))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([r.tobytes().hex() for r in codes], pa.string()), pa.array(error, pa.int64())], schema=kind)

    return run


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks from the sums of all tasks; unused entries stay."""
    parts, entries, width = books.shape
    each = state.where("kind = 'sums'").select(F.posexplode("sums").alias("slot", "x")).groupBy("slot").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = books.copy()
    total = {r.slot: int(r.x) for r in each.collect()}  # parts x entries x (width + 1) numbers at most
    for p in range(parts):
        for k in range(entries):
            at = (p * entries + k) * (width + 1)
            if n := total.get(at + width, 0):
                out[p, k] = [total[at + j] // n for j in range(width)]
    return out


def codebook_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def encoded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of all rows of ``vectors`` (vec_id, label, embedding) that can be used, written; and the codebooks."""
    spark = vectors.sparkSession
    since = mark()
    ids = vectors.select("vec_id", "label", "embedding")
    plain = StructType([ids.schema["vec_id"], ids.schema["label"]])
    kept_type = _with(plain, "v binary")

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, v = _integers(batch["embedding"])
            some = batch.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([some["vec_id"], some["label"], pa.array(v, pa.binary())], names=["vec_id", "label", "v"])

    kept = written(ids.mapInArrow(integers, kept_type), "integers")
    longest = (kept.agg(F.max(F.octet_length("v"))).first()[0] or 0) // 4
    width = -(-longest // parts)
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.zeros((parts, len(start), width), np.int64)
    if start:
        books[:] = _matrix(pa.array([bytes(r.v) for r in start], pa.binary()), parts, width).transpose(1, 0, 2)
    state_type = _with(kept_type, "codes binary, upper binary, lower binary, sums array<bigint>, kind string")
    before = None
    state = kept
    for k in range(rounds if start else 0):
        step = Step(before, books)
        state = written(state.mapInArrow(_round(step, to_arrow_schema(state_type)), state_type), f"round{k}", by="kind")
        sweep(since)
        before, books = books, _moved(state, books)
        state = state.where("kind = 'vector'")
    out_type = _with(plain, "code string, error bigint")
    final = state.mapInArrow(_last(Step(before, books), to_arrow_schema(out_type)), out_type) if start else spark.createDataFrame([], out_type)
    out = written(final, "coded")
    sweep(since)
    return out, books


def _with(schema: StructType, more: str) -> StructType:
    return StructType([*schema, *StructType.fromDDL(more)])


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable row of ``embeddings``; null labels are summed together. See the module for nulls, ties, repeated and ragged rows."""
    coded, books = encoded(table(spark, sf_dir, "embeddings"))
    # a key for each label, null too
    coded = coded.withColumn("_label", F.when(F.col("label").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("label").cast("string"))))
    per = coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    digest = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    return looked_up(coded, per, "_label", "_rows", 2).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """All rounds unrolled; an assignment is the least (distance, entry) of all entries."""
    w = ["x AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
         " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
         "p AS MATERIALIZED (SELECT r, k AS part, list_slice(v, k * (len(v) // 8) + 1, (k + 1) * (len(v) // 8)) AS v FROM x, range(8) t(k))",
         "c0 AS MATERIALIZED (SELECT part, r - 1 AS e, v FROM p WHERE r <= 16)"]
    for k in range(ROUNDS + 1):
        w.append(f"a{k} AS MATERIALIZED (SELECT r, part, min(struct_pack(d := d, e := e)) AS m FROM (SELECT p.r, p.part, c.e, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{k} c USING (part)) GROUP BY r, part)")
        if k < ROUNDS:
            w.append(f"c{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT part, e, list(f ORDER BY j) AS v FROM (SELECT part, a.m.e AS e, j, CAST(sum(p.v[j]) AS HUGEINT) AS s, count(*) AS n,"
                     f" CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f FROM a{k} a JOIN p USING (r, part), range(1, len(p.v) + 1) t(j) GROUP BY part, a.m.e, j) GROUP BY part, e) n USING (part, e))")  # fmt: skip
    return "WITH " + ",\n".join(w) + f"""
, f AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) FROM c{ROUNDS}) AS codebooks_sha256 FROM f JOIN x USING (r)"""


ORACLE = _oracle()
