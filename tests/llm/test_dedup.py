"""Exact and near deduplication."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from oracle import SF, duck, same_rows
from pyspark.sql import functions as F

from tessera.llm import near_duplicates as nd
from tessera.llm.components import components
from tessera.llm.exact_dedup import chunks, drop_exact_copies, exact_dedup
from tessera.llm.registry import ORACLE_SQL, QUERIES

from llm_tables import LONG, TRICKY, table  # isort: skip


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, name):
    df = QUERIES[name](spark, SF)
    rel = duck(SF).sql(ORACLE_SQL[name])
    assert same_rows(df.collect(), df.columns, rel.fetchall(), list(rel.columns))


def check_exact(rows, got):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[lowered(text)].append(doc)
    assert len(got) == len(rows)
    by_digest = {hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(): g for t, g in groups.items()}
    kept = defaultdict(int)
    for r in got:
        g = by_digest[r.text_sha256]
        assert r.group_size == len(g) and r.keep_id == max((x for x in g if x is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_tricky(spark, tricky, empty):
    check_exact(TRICKY, exact_dedup(tricky).collect())
    assert exact_dedup(empty).count() == 0
    left = drop_exact_copies(tricky)
    assert left.columns == tricky.columns and left.count() == len({lowered(t) for _, t in TRICKY})


def test_exact_small_chunks_and_weak_identifiers(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abc ") for _ in range(40)) for _ in range(6)]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 5)))) for i in range(300)]
    df = table(spark, rows)
    check_exact(rows, exact_dedup(df, least=8, most=32).collect())
    weak = lambda c: F.char_length(c).cast("long")  # names many chunks
    check_exact(rows, exact_dedup(df, least=8, most=32, identifier=weak).collect())


def test_chunks_are_the_text(spark):
    df = spark.createDataFrame([(t or "",) for _, t in TRICKY], "t string").select("t", chunks(F.col("t"), 16, 64).alias("c"))
    for r in df.collect():
        assert b"".join(r.c) == r.t.encode() and all(0 < len(x) <= 64 for x in r.c)


def test_cuts_follow_content(spark):
    """In any script, texts that share a stretch share most of its chunks wherever it stands."""
    rng = random.Random(8)
    scripts = ["etaoin shrdlu,.", "абвгдежз ийкл", "日本語文字列漢字中国東京大阪語彙。", "0123456789abcdef", "ابتثجحخ دذرز", "กขฃคฅฆงจฉชซ"]
    rows = []
    for i, letters in enumerate(scripts):
        text = "".join(rng.choice(letters) for _ in range(60_000))
        rows += [(i, 0, text), (i, 1, "new " + "".join(rng.choice(letters) for _ in range(777)) + text)]
    got = {(r.i, r.k): r.c for r in spark.createDataFrame(rows, "i int, k int, t string").select("i", "k", chunks(F.col("t")).alias("c")).collect()}
    for i, letters in enumerate(scripts):
        a, b = got[i, 0], got[i, 1]
        assert sum(x in {*b} for x in a) >= 0.7 * len(a), (letters, len(a), sum(x in {*b} for x in a))
        assert sum(len(x) == 8192 for x in a) <= 0.1 * len(a), letters


def test_stages_keep_clashing_columns(spark):
    """Columns that the stages' own would hide stay as they are."""
    docs = spark.createDataFrame([(1, "a b", "x", "y", "z"), (2, "A b", "x", "y", "z"), (3, "c", None, "y", "z")], "doc_id long, text string, text_sha256 string, _text_md5 string, text_md5 string")
    for stage in (drop_exact_copies, nd.keep_one_of_each):
        left = stage(docs)
        assert left.columns == docs.columns and {tuple(r)[2:] for r in left.collect()} == {("x", "y", "z"), (None, "y", "z")}


def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def shingle_set(text, k=5):
    w = words_of(text)
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    """(class id, class size, links) of each row, by all pairs."""
    sets = [shingle_set(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= threshold * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = []
    for i in range(len(rows)):
        g = groups[root(i)]
        out.append((rows[i][0], min((rows[x][0] for x in g if rows[x][0] is not None), default=None), len(g), links[i]))
    return sorted(out, key=str)


def near(df, **options):
    return sorted(((r.doc_id, r.class_id, r.class_size, r.n_links) for r in nd.near_duplicates(df, **options).collect()), key=str)


def test_near_tricky(spark, tricky, empty):
    assert near(tricky) == brute(TRICKY)
    assert near(tricky, threshold=0.33333) == brute(TRICKY, 0.33333)
    assert nd.near_duplicates(empty).count() == 0
    left = nd.keep_one_of_each(tricky)
    assert left.columns == tricky.columns and left.count() == 11


@pytest.mark.parametrize(("bucket", "group", "mb"), [(512, 768, 4), (3, 4, 4), (512, 768, 0.002)])
def test_near_groups_in_blocks(spark, bucket, group, mb):
    rng = random.Random(bucket)
    base = [[f"w{rng.randrange(4000)}" for _ in range(60)] for _ in range(4)]
    shared = [f"s{i}" for i in range(12)]
    rows = []
    for i in range(110):
        w = list(base[0] if i < 60 else base[i % 4])
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join([f"u{i}_{j}" for j in range(30)] + shared)) for i in range(30)]  # a shared passage is no near copy
    rows += [(None, " ".join(f"n{i}_{j}" for j in range(20))) for i in range(40)] + [(None, " ".join([*base[1], f"x{i}"])) for i in range(20)]
    assert near(table(spark, rows), bucket_block=bucket, group_block=group, block_mb=mb) == brute(rows)


def test_pruning_keeps_true_pairs():
    import numpy as np

    rng = np.random.default_rng(3)
    least = nd.least_matches(0.8, 1e-6)
    assert least == sorted(least) and least[-1] < 0.8 * nd.VALUES
    lost = 0
    for _ in range(300):
        common = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = (np.unique(np.r_[common, rng.integers(0, 2**63, 50, dtype=np.uint64)]) for _ in range(2))  # similarity 0.8
        sig = np.stack([nd.signature(a), nd.signature(b)])
        shared = [k for k in range(nd.VALUES // nd.ROWS) if (sig[0, 4 * k : 4 * k + 4] == sig[1, 4 * k : 4 * k + 4]).all()]
        if shared:
            hit = nd.surviving(sig, np.array([0]), np.array([1]), np.array([shared[0]]), least)
            lost += len(hit) == 0
            for later in shared[1:]:
                assert len(nd.surviving(sig, np.array([0]), np.array([1]), np.array([later]), least)) == 0
        else:
            lost += 1
    assert lost == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 40)] + [(500, 500)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == ends
    groups, labels = defaultdict(set), defaultdict(set)
    for x in ends:
        groups[root(x)].add(x)
        labels[got[x]].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, labels.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_text_is_read_whole():
    assert len(shingle_set(LONG)) == len(nd.shingles(LONG)) and len(nd.shingles(LONG + " tail")) == len(nd.shingles(LONG)) + 1
