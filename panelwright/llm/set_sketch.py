"""MinHash near-dedup with SetSketch registers.

A register is the least of exponentially distributed hash values over a set's shingles, on a
logarithmic scale and truncated: floor(1 - log_b(least)), from 0 to LAST. The sketch of a
union is the registers' maximum, so a long text is sketched in pieces. With b near 1 two
registers are equal about as often as the Jaccard similarity says.

Runs of ROWS registers are a band's value; rows that share one meet. At a similarity of 0.85
a pair shares none of the bands once in about 7 * 10^8 times. What meets is dealt to tiles;
there a pair's joint likelihood, from how many registers are greater, less and equal and from
the sizes of both sets, says whether it can still reach the threshold: pairs whose most
likely similarity is lower, by more than CERTAIN in log-likelihood, are left. The rest is
intersected exactly, and a link is confirmed on the words themselves.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table
from .hashes import mix
from .jaccard_join import Bound, groups_by_keys, link_tile, shingle_set

#: Base of the scale, rate of the exponential values, last value of a register.
BASE, RATE, LAST = 1.001, 20.0, (1 << 16) - 1
#: Bands and the registers of each.
BANDS, ROWS = 64, 8
REGISTERS = BANDS * ROWS
#: Shingles that are hashed at a time.
PIECE = 1 << 15
#: Registers that a pair is judged by first, and how much less likely the threshold must be than the best fit.
FIRST, CERTAIN = 128, 20.0

_SALT = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64))
_FACTOR = mix(_SALT) | np.uint64(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The sketches of sets of 64-bit hashes, a row each; an empty set's are 0."""
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint16)
    pieces = [(k, s[at : at + PIECE]) for k, s in enumerate(sets) for at in range(0, len(s), PIECE)]
    first = 0
    while first < len(pieces):
        last, held = first, 0
        while last < len(pieces) and (last == first or held + len(pieces[last][1]) <= PIECE):
            held += len(pieces[last][1])
            last += 1
        flat = np.concatenate([p for _, p in pieces[first:last]])
        starts = np.cumsum([0, *[len(p) for _, p in pieces[first : last - 1]]])
        least = np.empty((REGISTERS, last - first), dtype=np.uint64)
        for r in range(REGISTERS):
            least[r] = np.minimum.reduceat((flat ^ _SALT[r]) * _FACTOR[r], starts)
        found = on_scale(least.T)
        for (k, _), own in zip(pieces[first:last], found, strict=True):
            np.maximum(out[k], own, out=out[k])
        first = last
    return out


def on_scale(least: np.ndarray) -> np.ndarray:
    """Registers of the least uniform 64-bit hashes."""
    uniform = (least.astype(np.float64) + 0.5) * 2.0**-64
    waited = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(waited) / math.log(BASE)), 0, LAST).astype(np.uint16)


def merged(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum.reduce(sketches)


def cardinality(sketch: np.ndarray) -> float:
    """How many members a set has, as its sketch says."""
    return REGISTERS * (1 - 1 / BASE) / (RATE * math.log(BASE) * float(np.sum(BASE ** -sketch.astype(np.float64))))


def _share(x: np.ndarray) -> np.ndarray:
    """How often one set's register is the greater, if it alone holds a share x of the union's rate."""
    return -np.log1p(-np.maximum(x, 1e-9) * (BASE - 1) / BASE) / math.log(BASE)


def log_likelihood(j: np.ndarray, u: np.ndarray, greater: np.ndarray, less: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Of a similarity j, given both sets' sizes (u: the first one's share of their sum) and the registers' order."""
    v = 1 - u
    more, fewer = _share(u - v * j), _share(v - u * j)
    return greater * np.log(more) + less * np.log(fewer) + equal * np.log(np.maximum(1 - more - fewer, 1e-9))


def most_likely(u: np.ndarray, greater: np.ndarray, less: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood, by ternary search: the likelihood is concave."""
    low, high = np.zeros_like(u), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(24):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = log_likelihood(a, u, greater, less, equal) < log_likelihood(b, u, greater, less, equal)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


def may_reach(mine: np.ndarray, others: np.ndarray, n_mine: int, n_others: np.ndarray, least: float) -> np.ndarray:
    """Whether the pairs of a sketch with others may have a similarity of least, by their likelihood."""
    greater = (others < mine).sum(axis=1).astype(float)
    equal = (others == mine).sum(axis=1).astype(float)
    less = len(mine) - greater - equal
    u = n_mine / (n_mine + n_others)
    best = most_likely(u, greater, less, equal)
    bound = np.minimum(least, np.minimum(u / (1 - u), (1 - u) / u))
    lost = log_likelihood(best, u, greater, less, equal) - log_likelihood(bound, u, greater, less, equal)
    return (best >= bound) | (lost <= CERTAIN)


def sketch_bound(sets: list[np.ndarray], carried: list[bytes], num: int, den: int) -> Bound:
    """Which of a tile's rows may link with row x, by the joint likelihood of their sketches."""
    sizes = np.array([len(s) for s in sets], dtype=float)
    all_registers = np.stack([np.frombuffer(c, dtype=np.uint16) for c in carried])
    firsts = np.ascontiguousarray(all_registers[:, :FIRST])

    def may_link(x: int, near: np.ndarray) -> np.ndarray:
        for part in (firsts, all_registers):
            if len(near):
                near = near[may_reach(part[x], part[near], sizes[x], sizes[near], num / den)]
        return near

    return may_link


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """Hashes of the bands' values, a row a sketch."""
    lanes = sketches.reshape(len(sketches), BANDS, ROWS).view(np.uint64)  # a band's eight registers are two lanes
    tag = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1 << 40))
    return mix(mix(lanes[:, :, 0] ^ tag) + lanes[:, :, 1])


def sketch_groups(docs: DataFrame, num: int = 85, den: int = 100, size: int = 5, id_col: str = "doc_id", text_col: str = "text", with_links: bool = False) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id, kept, head, row_no, text_hash, again; n_links if asked for.

    Rows link when den * |A and B| >= num * |A or B| for their sets of word shingles; what is
    said there of jaccard_groups holds here, nulls, empty texts, repeated rows and ids, long
    texts, empty tables and clashing names included. kept: the row's id is its component's.
    A link is missed only if no band of its rows' sketches agrees or their likelihood is
    wrong by CERTAIN, about once in 10^8 at the thresholds of 0.8 and more that the bands
    are made for; all confirmed links are exact.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))

    def sketched(batches):
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([r.tobytes() for r in registers(sets)], pa.binary()),
                batch.column(2),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "print", "sketch", "h"])

    def keys(batches):
        for batch in batches:
            found = [band_keys(np.frombuffer(s, dtype=np.uint16).reshape(1, -1))[0] for s in batch.column(1).to_pylist()]
            at = pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS)
            flat = np.concatenate([*found, np.empty(0, dtype=np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(flat))], names=["row", "keys"])

    keyed = own.mapInArrow(sketched, f"id {kind}, n long, print binary, sketch binary, h long")
    keys_of = lambda rows: rows.where("n > 0").select("row", "sketch").mapInArrow(keys, "row long, keys array<long>")
    tile = partial(link_tile, num=num, den=den, size=size, bound=sketch_bound)
    out = groups_by_keys(own, keyed, keys_of, tile, num, den, id_col, with_links, carry="sketch")
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, component at a similarity of 0.85 over five-word shingles, and whether it stays."""
    return sketch_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) r USING (doc_id)
"""
