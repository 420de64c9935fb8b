"""Nearest neighbours by inner product with additive quantisation.

A vector is coded as a sum of one full-dimensional codeword from each codebook. Codebooks come from
residual k-means on a bounded sample, refined by least squares over all of them; the encoder searches
with a beam. Directions are coded, norms are stored beside the codes, with the length of what a code misses of its
direction. A query scores codes by adding up entries of its lookup table. The best codes of a block are scored with
the original vectors; by the worst of the nearest among them and by what the codes miss, no other row can be nearer
than those whose upper bound reaches it, and these are scored too. So no row is lost, however the vectors lie.

Equal vectors are one entry of the index with their least ids: of ids tied in score only as many as
are asked for can be in a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.shared import materialise

#: Bound of the sample that codebooks are fitted to (rows of smallest hash of the id).
SAMPLE = 16_384
CODEBOOKS, WORDS, BEAM, ROUNDS = 20, 256, 4, 6
#: How often the codebooks are refitted to the codes that the beam finds, and the rounds over all codebooks in each.
REFITS, SWEEPS = 2, 6
#: Codes of a query and a block that are scored exactly first; the bound that these give decides on the others.
RERANK = 64
#: Index blocks whose best codes of a query are merged in one step.
FAN_IN = 32
QUERY_BLOCK, INDEX_BLOCK = 256, 8192
#: Components of the vectors of an index block, at most.
BLOCK_SIZE = 1 << 20


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        sums, count = _sums(x, (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1), k)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
        centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


class Codebooks:
    """Codewords (codebooks, words, dimensions) with the encoder and the lookup tables."""

    def __init__(self, words: np.ndarray):
        self.words = words.astype(np.float32)
        self.m, self.k, self.d = words.shape
        self.flat = self.words.reshape(-1, self.d)
        self.squares = (self.words * self.words).sum(2)

    def __reduce__(self):
        return Codebooks, (self.words,)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (rows, codebooks) of vectors, by beam search over the squared error."""
        out = [self._encode(x[i : i + 256].astype(np.float32), beam) for i in range(0, len(x), 256)]
        return np.concatenate(out) if out else np.zeros((0, self.m), np.uint8)

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n = len(x)
        rest, error = x[:, None, :], np.zeros((n, 1), np.float32)
        codes = np.zeros((n, 1, self.m), np.uint8)
        every, doubled = np.arange(n), -2 * self.words.transpose(0, 2, 1)
        for m in range(self.m):
            # squared error of a beam's residual with each word taken off, but for the vector's own square
            step = (rest.reshape(-1, self.d) @ doubled[m]).reshape(n, -1, self.k)
            step += self.squares[m]
            step += error[:, :, None]
            step = step.reshape(n, -1)
            keep = min(beam, step.shape[1])
            best, error = np.empty((n, keep), np.int64), np.empty((n, keep), np.float32)
            for b in range(keep):  # for so few quicker than a partition
                best[:, b] = step.argmin(1)
                error[:, b] = step[every, best[:, b]]
                step[every, best[:, b]] = np.inf
            codes = np.take_along_axis(codes, (best // self.k)[:, :, None], 1)
            codes[:, :, m] = best % self.k
            rest = np.take_along_axis(rest, (best // self.k)[:, :, None], 1) - self.words[m][best % self.k]
        return codes[every, error.argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(self.m))

    def score(self, queries: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Estimated inner products (queries, codes), from a lookup table of each query."""
        tables = queries.astype(np.float32) @ self.flat.T
        total = np.zeros((len(queries), len(codes)), np.float32)
        for m in range(self.m):
            total += np.take(tables[:, m * self.k : (m + 1) * self.k], codes[:, m], axis=1)
        return total * scale


def _sums(rows: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the rows of each of `k` kinds, and their number."""
    count, order = np.bincount(of, minlength=k), np.argsort(of, kind="stable")
    padded = np.vstack([rows[order], np.zeros((1, rows.shape[1]), rows.dtype)])
    sums = np.add.reduceat(padded, np.cumsum(count) - count, axis=0)
    sums[count == 0] = 0
    return sums, count


def fit(sample: np.ndarray, codebooks: int = CODEBOOKS, words: int = WORDS, seed: int = 0) -> Codebooks:
    """Codebooks for `sample` (rows, dimensions): residual k-means, then least squares over all codebooks for the codes
    that the beam finds, one codebook after the other with the rest held fixed, so that no table of all pairs is needed."""
    x = sample.astype(np.float32)
    rng, k, rest, found = np.random.default_rng(seed), min(words, len(x)), x.copy(), []
    for _ in range(codebooks):
        centres = _kmeans(rest, k, rng)
        rest -= centres[(rest @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)]
        found.append(centres)
    books = Codebooks(np.stack(found))
    for _ in range(REFITS):
        codes, table = books.encode(x), books.words.copy()
        rest = x - books.decode(codes)
        for _ in range(SWEEPS):
            for m in range(codebooks):
                # the mean of what the other codebooks leave, pulled a little to what was, so that rare words stay in place
                sums, count = _sums(rest, codes[:, m], k)
                move = sums / (count + np.float32(0.5))[:, None]
                table[m] += move
                rest -= move[codes[:, m]]
        books = Codebooks(table)
    return books


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 and the lengths of `x`; scaled first, so that no square overflows or vanishes."""
    most = np.abs(x).max(1, keepdims=True)
    unit = x / most
    norm = np.linalg.norm(unit, axis=1, keepdims=True)
    return unit / norm, (most * norm)[:, 0]


def _vectors(rows: pa.Array, n: int) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _encode(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Codebooks = books.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, _ = directions(_vectors(batch.column("embedding"), batch.num_rows))
            codes = model.encode(unit)
            decoded = model.decode(codes).astype(np.float64)
            square = (decoded * decoded).sum(1)
            scale = np.divide((unit * decoded).sum(1), square, out=np.zeros_like(square), where=square > 0).astype(np.float32)
            miss = np.linalg.norm(unit - scale[:, None] * decoded, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("embedding"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(miss)], ["cid", "embedding", "codes", "scale", "miss"])

    return run


def _search(books, first: int, k: int):
    """Of each pair of a query block and an index block, the `k` nearest entries of each query with their exact scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Codebooks = books.value
        # what sums of single-precision products can be off, for a query of length 1
        rounding = (model.d + model.m) * 2.0**-22 * np.sqrt(model.squares.max(1).astype(np.float64)).sum()
        for batch in batches:
            for row in range(batch.num_rows):
                queries, index = batch.column("queries")[row].values, batch.column("entries")[row].values
                asked, x = _vectors(queries.field("embedding"), len(queries)), _vectors(index.field("embedding"), len(index))
                codes = np.frombuffer(b"".join(index.field("codes").to_pylist()), np.uint8).reshape(len(index), -1)
                cids, scale, miss = (index.field(c).to_numpy(zero_copy_only=False) for c in ("cid", "scale", "miss"))
                (_, norm), (unit, length) = directions(x), directions(asked)
                near = model.score(unit, codes, scale).astype(np.float64)
                slack = miss + rounding * np.abs(scale) + 1e-12
                most, kept = min(max(first, k), len(cids)), min(k, len(cids))
                scores, found = np.empty((len(queries), kept)), np.empty((len(queries), kept), np.int64)
                for q in range(len(queries)):
                    some = np.argpartition(-near[q] * norm, most - 1)[:most]
                    least = np.partition(np.einsum("ij,j->i", x[some], asked[q]), most - kept)[most - kept]
                    # negated, so that a bound that is not a number keeps its row
                    some = np.flatnonzero(~((near[q] + slack) * norm < least / length[q]))
                    exact = np.einsum("ij,j->i", x[some], asked[q])
                    best = np.lexsort((cids[some], -exact))[:kept]
                    scores[q], found[q] = exact[best], cids[some][best]
                # the score negated, so that the ascending order is nearest first, then the smaller id
                pairs = pa.StructArray.from_arrays([pa.array(-scores.ravel()), pa.array(found.ravel())], ["far", "cid"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(queries) + 1) * kept, pa.int32()), pairs)
                block = pa.array(np.full(len(queries), batch.column("block")[row].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([queries.field("cid"), block, lists], ["qcid", "block", "found"])

    return run


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part: with an id, of the most frequent length, without null or
    non-finite components, not all zero; of rows that repeat an id, the one with the least vector."""
    x = F.col("embedding")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x).where(F.col("vec_id").isNotNull() & x.isNotNull()).where(F.coalesce(good, F.lit(False)))
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).first()
    rows = rows.where(F.size("embedding") == (sizes["size"] if sizes else 0))
    if rows.groupBy("vec_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return rows


def nearest_by_inner_product(vectors: DataFrame, every: int = 20, k: int = 20, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """Columns (query_id, rank, vec_id, score): for each row of `vectors` (vec_id, embedding) whose vec_id is divisible by
    `every`, its `k` nearest found among all other rows, by inner product in double precision.

    Ties go to the smaller vec_id; with fewer than `k` candidates all are returned. See valid_vectors for rows
    that take no part. No valid vector, or no query: no rows. Further columns are ignored. Codebooks are
    fitted to at most `sample` rows (16,384 x dimensions x 4 bytes on the driver); every row is indexed, and
    each query is scored against every code by its table: work grows with queries x rows. `rerank` codes of a
    query and a block are scored exactly first; it affects the time, not the result.
    """
    spark = vectors.sparkSession
    rows = materialise(valid_vectors(vectors), "vectors")
    few = Window.partitionBy("embedding").orderBy("vec_id")
    entries = rows.withColumn("place", F.row_number().over(few)).where(F.col("place") <= k + 1)
    classes = materialise(entries.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).withColumn("cid", F.col("members")[0]), "classes")
    n = classes.count()
    out = "query_id long, rank int, vec_id long, score double"
    chosen = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("embedding").toPandas()["embedding"] if n else []
    if not len(chosen):
        return spark.createDataFrame([], out)
    books = spark.sparkContext.broadcast(fit(directions(np.stack(list(chosen)).astype(np.float64))[0]))

    kind = classes.schema["embedding"].dataType.simpleString()
    codes = classes.select("cid", "embedding").mapInArrow(_encode(books), f"cid long, embedding {kind}, codes binary, scale float, miss double")
    blocks = -(-n // max(1, min(INDEX_BLOCK, BLOCK_SIZE // len(chosen[0]))))
    index = codes.groupBy(F.pmod(F.xxhash64("cid"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("cid", "embedding", "codes", "scale", "miss")).alias("entries"))
    asking = rows.where(F.col("vec_id") % every == 0)
    of_class = materialise(asking.join(classes.select("embedding", "cid"), "embedding").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qcid")), "queries")
    distinct = materialise(of_class.select(F.col("qcid").alias("cid")).distinct().join(classes.select("cid", "embedding"), "cid"), "distinct")
    groups = max(1, -(-distinct.count() // QUERY_BLOCK))
    queries = distinct.groupBy(F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("cid", "embedding")).alias("queries"))
    # the stated queries against all rows: each block of queries goes to each block of the index
    sent = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    best = sent.join(index, "block").select("queries", "entries", "block").mapInArrow(_search(books, rerank, k + 1), "qcid long, block long, found array<struct<far: double, cid: long>>")
    # merged in levels, so that no row holds the finds of more than FAN_IN blocks
    while blocks:
        blocks = -(-blocks // FAN_IN) if blocks > FAN_IN else 0
        step = F.floor(F.col("block") / FAN_IN) if blocks else F.lit(0)
        best = best.groupBy("qcid", step.alias("block")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    top = best.select("qcid", F.explode("found").alias("near")).select("qcid", F.col("near.cid").alias("cid"), (-F.col("near.far")).alias("score"))
    each = top.join(classes.select("cid", "members"), "cid").select("qcid", "score", F.explode("members").alias("vec_id"))
    nearest = Window.partitionBy("qcid").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1)
    own = Window.partitionBy("query_id").orderBy("place")
    result = of_class.join(each, "qcid").where("query_id <> vec_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
