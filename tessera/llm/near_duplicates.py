"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of hashed five-word shingles. Texts with equal sets are one class, of which one member goes on. MinHash
signatures (128 values of 16 bits) are cut into 32 bands of 4; classes that share a band are candidates, which misses a
pair of similarity 0.8 once in 20 million. Candidate pairs are compared 16 values at a time: with a uniform prior, m
matches of n give the posterior probability P(Bin(n + 1, t) <= m) of reaching threshold t, and a pair goes as soon as it is
below ``tolerance``. The pairs that are left join classes into candidate groups, which bring their members' signatures and
shingle sets together once. There those same pairs (a shared band, not pruned), and no others, are verified exactly by the
sizes of set intersections; their links give the number of links of each document, and the classes.

Scale
- A bucket that has the members of another band's is read once; a pair counts only in the first band that it shares.
- A bucket or group of any size is dealt into blocks (of at most ``group_block`` members or ``block_mb`` of sets, in groups),
  and pairs of blocks are units of work for many tasks: a unit holds at most two blocks. Units return spanning edges and
  counts, never their pairs, so nothing is emitted with the square of a group; nothing is capped. A member of a group of n
  meets n / ``group_block`` blocks, so a group of n different near copies costs n * n / ``group_block`` rows and n * n pairs.
- Bucket tables hold 16 bytes a band and class; signatures move for members of shared buckets only, and shingle sets once,
  for members of candidate groups only.
- Components are found in the shared folder, round by round; no links reach the driver.

Cases: words are runs of letters, digits and non-ASCII characters of the lower-cased text. Null text counts as empty; texts
without words are copies of each other (one class). A text of one to four words is one shingle. Null and repeated doc_ids
are rows of their own; the class id is the least doc_id of the class (null only if all are null). An empty table gives no
rows. Extra columns are never read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialise, partitions, table, text_of, with_place, without
from tessera.llm.components import components, local_labels
from tessera.llm.hashing import U, segments, span_hashes

VALUES, ROWS, STEP = 128, 4, 16
#: A byte outside words ends a segment.
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 2**63, VALUES, dtype=np.uint64) * U(2) + U(1)
_ADD = _rng.integers(0, 2**64, VALUES, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams, made a segment of the text at a time."""
    found, before, seen = [], np.zeros(0, U), 0
    for raw in segments(text.lower().encode("utf-8", "surrogatepass"), _GAP):
        b = np.frombuffer(raw, np.uint8)
        inside = (b >= 128) | ((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57))
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        new = mixed(span_hashes(b, edge[::2], edge[1::2]))
        seen += len(new)
        h = np.r_[before, new]
        if len(h) >= words:
            found.append(np.unique(ngrams(h, words)))
        before = h[max(0, len(h) - words + 1) :]
    if not seen:
        return np.zeros(0, np.uint64)
    return np.unique(np.concatenate(found)) if seen >= words else ngrams(before, len(before))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    m = len(h) - n + 1
    out = np.zeros(m, U)
    for i in range(n):
        out = mixed(out * U(0x9E3779B97F4A7C15) + h[i : i + m])
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits of each; zeros for an empty set."""
    least = np.full(VALUES, 2**64 - 1, U)
    for i in range(0, len(s), 1024):
        least = np.minimum(least, (s[i : i + 1024, None] * _MULTIPLY + _ADD).min(0))
    return (mixed(least) >> U(48)).astype("<u2")


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = STEP, 2 STEP, ...: the least m whose posterior P(Bin(n + 1, t) <= m) is ``tolerance`` or more."""
    found = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append(m)
    return found


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by their first ``keys`` columns; a group is never split."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        cut = t.num_rows - 1
        last = t.slice(cut).select(range(keys)).to_pylist()[0].values()
        same = np.ones(t.num_rows, bool)
        for i, v in enumerate(last):
            same &= t.column(i).to_numpy() == v
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def bounds(t: pa.Table, keys: int) -> np.ndarray:
    """Where groups start, and the end."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for i in range(keys):
        c = t.column(i).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.r_[np.flatnonzero(new), t.num_rows]


def pairs_of(block: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a unit: of a block with itself, or of its two blocks."""
    n = len(block)
    if same:
        return np.triu_indices(n, 1)
    a, b = np.flatnonzero(block == block[0]), np.flatnonzero(block != block[0])
    return np.repeat(a, len(b)), np.tile(b, len(a))


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs share their unit's band first and are not pruned."""
    keep = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    fresh = np.ones(len(a), bool)  # no earlier band is shared
    shared = np.zeros(len(a), bool)
    for step, most in enumerate(least):
        lo = step * STEP
        equal = sig[a[keep], lo : lo + STEP] == sig[b[keep], lo : lo + STEP]
        matches[keep] += equal.sum(1, dtype=np.int32)
        whole = equal.reshape(len(keep), STEP // ROWS, ROWS).all(2)
        for i in range(STEP // ROWS):
            now = step * (STEP // ROWS) + i
            fresh[keep] &= ~(whole[:, i] & (band[keep] > now))
            shared[keep] |= whole[:, i] & (band[keep] == now)
        keep = keep[(matches[keep] >= most) & fresh[keep]]
    return keep[shared[keep]]


def not_pruned(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs share a band and are not pruned."""
    keep = np.arange(len(a))
    matches, shared = np.zeros(len(a), np.int32), np.zeros(len(a), bool)
    for step, most in enumerate(least):
        lo = step * STEP
        equal = sig[a[keep], lo : lo + STEP] == sig[b[keep], lo : lo + STEP]
        matches[keep] += equal.sum(1, dtype=np.int32)
        shared[keep] |= equal.reshape(len(keep), STEP // ROWS, ROWS).all(2).any(1)
        keep = keep[matches[keep] >= most]
    return keep[shared[keep]]


def intersections(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets ``rows`` with sets ``columns``; memory is bounded by ``width``."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[place]
    owner, at = owner[keep], number[place[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(rows), len(columns)), np.float32)
    for lo in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(at, (lo, lo + width))
        m = np.zeros((len(sets), width), np.float32)
        m[owner[i:j], at[i:j] - lo] = 1
        out += m[rows] @ m[columns].T
    return out.astype(np.int64)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5, tolerance: float = 1e-6, bucket_block: int = 256, group_block: int = 128, block_mb: float = 4, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """One row per document: doc_id, class_id, class_size (documents), n_links (other documents at ``threshold`` or more).

    ``with_kept`` adds text_md5 and kept: true for the row of least (doc_id, text_md5) in its class, null ids last.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    share = Fraction(str(threshold))
    rows = with_place(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), "path", "row", "near-rows")
    told = rows.select("doc_id", "text", "path", "row", (F.md5("text") if with_kept else F.lit("")).alias("text_md5"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks, sigs, sizes = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), words)
                marks.append(digest(s))
                sigs.append(signature(s).tobytes())
                sizes.append(len(s))
            kept = [b.column(i) for i in (0, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(marks, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "path", "row", "text_md5", "mark", "n", "sig"])

    every = materialise(told.mapInArrow(sketch, "doc_id long, path string, row long, text_md5 string, mark binary, n long, sig binary"), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")
    found = every.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.min(first).alias("first"), F.min(F.struct("path", "row")).alias("at"), F.count("*").alias("size"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    classes = materialise(found.withColumn("cid", F.monotonically_increasing_id()), "classes")

    # Buckets that two classes or more share, each set of members once.
    bands = (
        classes.where("n > 0")
        .select("cid", F.posexplode(F.expr(f"transform(sequence(0, {VALUES // ROWS - 1}), b -> substring(sig, b * {2 * ROWS} + 1, {2 * ROWS}))")).alias("band", "part"))
        .select("cid", "band", F.xxhash64("band", "part").alias("key"))
    )
    filled = bands.groupBy("key", "band").agg(F.count("*").alias("cnt"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("y")).where("cnt > 1")
    buckets = materialise(filled.groupBy("cnt", "x", "y").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key", "cnt"), "buckets")
    blocks = F.ceil(F.col("cnt") / bucket_block).cast("int")
    members = bands.join(buckets, ["key", "band"]).withColumn("own", F.pmod(F.xxhash64(F.lit(2), "cid"), blocks).cast("int"))
    units = members.select("key", "band", "cid", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    units = units.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "cid")
    units = units.join(classes.select("cid", "sig"), "cid").select("key", "band", "i", "j", "own", "cid", "sig")
    least = least_matches(threshold, tolerance)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 4):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, VALUES)
            cid, own, band = (t.column(c).to_numpy() for c in ("cid", "own", "band"))
            same = t.column("i").to_numpy() == t.column("j").to_numpy()
            at, got, waiting = bounds(t, 4), [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                a, b = pairs_of(own[lo:hi], same[lo])
                waiting.append((a + lo, b + lo))
                if sum(len(w[0]) for w in waiting) > 100_000 or hi == at[-1]:
                    a, b = (np.concatenate(x) for x in zip(*waiting, strict=True))
                    for part in range(0, len(a), 200_000):
                        x, y = a[part : part + 200_000], b[part : part + 200_000]
                        keep = surviving(sig, x, y, band[x], least)
                        got.append((x[keep], y[keep]))
                    waiting = []
            if not got:  # lone members of a block
                continue
            a, b = (np.concatenate(x) for x in zip(*got, strict=True))
            group = np.repeat(np.arange(len(at) - 1), np.diff(at))
            label = local_labels(t.num_rows, a, b)  # edges never leave a unit
            some = np.flatnonzero((label != np.arange(t.num_rows)) & (group[label] == group))
            yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(cid[label[some]])], names=["a", "b"])

    keyed = units.repartition(n, "key", "i", "j").sortWithinPartitions("key", "band", "i", "j")
    groups = components(materialise(keyed.mapInArrow(prune, "a long, b long"), "candidates"))

    # Exact verification within candidate groups; shingle sets are made anew for their members only.
    joined = materialise(classes.select("cid", "at", "size", "n", "sig").join(groups.select(F.col("node").alias("cid"), F.col("label").alias("grp")), "cid"), "members")
    counts = materialise(joined.groupBy("grp").agg(F.count("*").alias("cnt"), F.sum("n").alias("total")), "groups")
    blocks = F.least("cnt", F.greatest(F.ceil(F.col("cnt") / group_block), F.ceil(F.col("total") * 8 / int(block_mb * 2**20)))).cast("int")
    wanted = joined.join(counts, "grp").select("cid", "size", "grp", blocks.alias("blocks"), "sig", F.col("at.path").alias("path"), F.col("at.row").alias("row"))
    # A class is read from one row of it, told by file and place.
    texts = rows.select("path", "row", "text").join(wanted.hint("merge"), ["path", "row"]).select("text", "cid", "size", "grp", "blocks", "sig")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = pa.array([shingles(t.as_py(), words).tobytes() for t in b.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], data], names=["cid", "size", "grp", "blocks", "sig", "data"])

    own = F.pmod(F.xxhash64(F.lit(3), "cid"), F.col("blocks")).cast("int")
    with_sets = texts.mapInArrow(sets, "cid long, size long, grp long, blocks int, sig binary, data binary").withColumn("own", own)
    work = with_sets.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    work = work.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "size", "blocks", "sig", "data")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            at, out = bounds(t, 3), []
            names = ("own", "cid", "size", "blocks", "i", "j")
            owns, cids, sizes, blocks, i, j = (t.column(c).to_numpy() for c in names)
            data, signs = t.column("data"), t.column("sig")
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                mine, size = cids[lo:hi], sizes[lo:hi]
                a, b = pairs_of(owns[lo:hi], i[lo] == j[lo])
                sig = np.frombuffer(b"".join(signs.slice(lo, hi - lo).to_pylist()), "<u2").reshape(-1, VALUES)
                keep = not_pruned(sig, a, b, least)
                a, b = a[keep], b[keep]
                left, x = np.unique(a, return_inverse=True)
                right, y = np.unique(b, return_inverse=True)
                if len(a):
                    some = np.union1d(left, right)
                    s = [np.frombuffer(data[lo + int(k)].as_py(), "<u8") for k in some]
                    length = np.array([len(v) for v in s])
                    left, right = np.searchsorted(some, left), np.searchsorted(some, right)
                    common = intersections(s, left, right)[x, y]
                    union = length[left[x]] + length[right[y]] - common
                    sure = common * share.denominator >= union * share.numerator
                    a, b = a[sure], b[sure]
                links = np.bincount(a, size[b], len(mine)) + np.bincount(b, size[a], len(mine))
                out += [(0, int(c), int(k)) for c, k in zip(mine, links, strict=True) if k]
                label = local_labels(len(mine), a, b)
                final = 1 if blocks[lo] == 1 else 2
                out += [(final, int(mine[k]), int(mine[v])) for k, v in enumerate(label.tolist()) if final == 1 or k != v]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["kind", "a", "b"])

    # kind 0: links of a class; 1: its component, whole in one unit; 2: an edge of a group of many units.
    checked = materialise(work.repartition(n, "grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(verify, "kind long, a long, b long"), "verified")
    label = checked.where("kind = 1").select(F.col("a").alias("cid"), F.col("b").alias("root"))
    if checked.where("kind = 2").limit(1).count():
        label = label.unionByName(components(checked.where("kind = 2").select("a", "b")).select(F.col("node").alias("cid"), F.col("label").alias("root")))
    links = checked.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("links"))
    placed = classes.select("cid", "mark", "rep", "first", "size").join(label, "cid", "left").join(links, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    placed = materialise(placed, "placed")
    whole = placed.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("size").alias("class_size"), F.min("first").alias("keep"))
    final = materialise(placed.join(whole, "root").select("mark", "class_id", "class_size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "keep"), "final")
    kept = [F.col("text_md5"), (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_md5") == F.col("keep.text_md5"))).alias("kept")] if with_kept else []
    return every.select("doc_id", "text_md5", "mark").join(final, "mark").select("doc_id", "class_id", "class_size", "n_links", *kept)


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, that of the least doc_id; same columns."""
    key = fresh(docs, "text_md5")
    seen = materialise(near_duplicates(docs, with_kept=True, **options).select("doc_id", F.col("text_md5").alias(key), "kept"), "decisions")
    # Rows alike in id and text are all marked kept: all but one are dropped.
    seen = seen.unionByName(seen.groupBy("doc_id", key).agg(F.count("*").alias("n")).where("n > 1").select("doc_id", key, F.lit(False).alias("kept")))
    return without(docs.withColumn(key, F.md5(text_of())), seen, key).drop(key)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10ffff}]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))
  UNION ALL
  SELECT x.doc_id, y.doc_id FROM w AS x JOIN w AS y ON len(x.w) = 0 AND len(y.w) = 0 AND x.doc_id <> y.doc_id
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT doc_id, class_id, class_size, coalesce(n_links, 0) AS n_links
FROM (SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM r GROUP BY a) AS c
LEFT JOIN (SELECT a, count(*) AS n_links FROM p GROUP BY a) AS l ON l.a = c.doc_id
"""
