"""Source mixing, packing and the pipeline."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_tables import TRICKY, table
from oracle import SF
from pyspark.sql import functions as F

from tessera.llm import mixing, packing

import corpus_pipeline  # isort: skip


def edf(weights, cycle):
    """Slots of one cycle, filled one after another by the earliest deadline among released blocks."""
    done, out = Counter(), []
    for t in range(cycle):
        ready = [(-(-(done[s] + 1) * cycle // w), s) for s, w in sorted(weights.items()) if done[s] < w and done[s] * cycle // w <= t]
        s = min(ready)[1]
        out.append((s, done[s]))
        done[s] += 1
    return out


@pytest.mark.parametrize("given", [None, {"a": 5.0, "b": 1.0, "c": 0.5}])
def test_mixing(spark, given):
    rows = [(i, f"t{i}", "a" if i % 3 == 0 else "b" if i % 7 else "c" if i % 2 else None) for i in range(1500)]
    got = mixing.mix(table(spark, rows), given, cycle=32, block_rows=4, range_rows=64).collect()
    assert sorted(r.doc_id for r in got) == list(range(1500)) and sorted(r.position for r in got) == list(range(1500))
    weights = {r.source: r.weight for r in got}
    assert sum(weights.values()) == 32 and min(weights.values()) >= 1
    if given is None:
        n = Counter(r[2] for r in rows)
        total = sum(math.sqrt(x) for x in n.values())
        assert all(abs(w - 1 - 28 * math.sqrt(n[s]) / total) < 1 for s, w in weights.items())
    names = {s: s or "" for s in weights}
    plan = {(s, k): t for t, (s, k) in enumerate(edf({names[s]: w for s, w in weights.items()}, 32))}
    blocks = defaultdict(list)
    for r in got:
        blocks[r.source, r.block].append(r.place)
        assert r.slot == r.block // r.weight * 32 + plan[names[r.source], r.block % r.weight]
    for s in weights:
        mine = sorted(b for x, b in blocks if x == s)
        assert mine == list(range(len(mine))) and all(len(blocks[s, b]) == 4 for b in mine[:-1])
    assert [(r.slot, r.place) for r in sorted(got, key=lambda r: r.position)] == sorted((r.slot, r.place) for r in got)
    end = min(max(r.slot for r in got if r.source == s) for s in weights)
    counts = Counter()
    taken = {(r.slot, r.source) for r in got if r.balanced}
    for t, s in sorted(taken, key=lambda x: x[0]):
        counts[s] += 1
        assert t <= end and all(abs(counts[x] - (t + 1) * w / 32) < 1 for x, w in weights.items())


def test_mixing_odd(spark, tricky, empty):
    got = mixing.mix(tricky, block_rows=2).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(d) for d, _ in TRICKY) and sorted(r.position for r in got) == list(range(len(TRICKY)))
    assert mixing.mix(empty).count() == 0
    rows = mixing.mix_rows(tricky)
    assert rows.columns == tricky.columns and rows.count() == len(TRICKY)
    with pytest.raises(ValueError):
        mixing.mix(table(spark, [(i, "x", f"s{i}") for i in range(20)]), cycle=16)


def test_mixture_order(spark, tmp_path):
    df = table(spark, [(i, f"t{i}", f"s{i % 3}") for i in range(300)])
    mixing.mix_rows(df, block_rows=5).write.parquet(str(tmp_path / "m"))
    order = [r.doc_id for f in sorted((tmp_path / "m").glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
    want = [r.doc_id for r in mixing.mix(df, block_rows=5).orderBy("position").collect()]
    assert order == want


def test_mixing_repeated_ids(spark, tmp_path):
    """Rows of null and of repeated ids are interleaved like any others, and a repeated id is many ranges' work."""
    rows = [(None, f"n{i}", "a") for i in range(300)] + [(7, f"s{i}", "b") for i in range(300)] + [(7, "same", "c")] * 200 + [(i, f"t{i}", "d") for i in range(100, 300)]
    docs = table(spark, rows).withColumnsRenamed({"mark": "mix_path", "h": "mix_position", "sig": "_mix_row"})
    got = mixing.mix(docs, block_rows=4, range_rows=16, cycle=16).collect()
    assert sorted(r.position for r in got) == list(range(1000)) and Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[2]) for r in rows)
    for part in (docs, spark.read.parquet(mixing.materialise(docs, "read").inputFiles()[0].rsplit("/", 1)[0])):
        made = mixing.mix_rows(part, block_rows=4, range_rows=16, cycle=16)
        assert made.columns == docs.columns
        mixed = made.collect()
        assert Counter((r.doc_id, r.text, r.source) for r in mixed) == Counter((r[0], r[1], r[2]) for r in rows)
        order = [r.source for r in mixed]
        plan = [r.source for r in sorted(got, key=lambda r: r.position)]
        assert order == plan  # the same schedule
        runs = max(sum(1 for _ in g) for _, g in itertools.groupby(order[:700]))
        assert runs <= 16, runs


def check_packed(got, texts):
    """Every id of every document once, in gapless sequences."""
    encode = packing.loaded(None)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append(r)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    want = defaultdict(list)
    for doc, text in texts:
        want[doc, len(encode.whole(text or "")) // 4 + 1].append(encode.whole(text or "") + np.array([2], "<u4").tobytes())
    assert set(want) == set(pieces)
    for key, bodies in want.items():
        mine = sorted(pieces[key], key=lambda r: r.start)
        if len(bodies) == 1:
            at = 0
            for r in mine:
                assert r.start == at and zlib.crc32(bodies[0][4 * at : 4 * (at + r.length)]) == r.ids_crc32
                at += r.length
        assert sum(r.length for r in mine) == key[1] * len(bodies)
    return padding, len(sequences)


def test_packing(spark, tricky, empty):
    check_packed(packing.pack(tricky).collect(), TRICKY)
    assert packing.pack(empty).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    padding, n = check_packed(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert padding == 0


def lengths(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[5]] += r[2]
    return sizes


@pytest.mark.parametrize("levels", [16, 4])
def test_sum_of_squares_choice(levels):
    """The window chosen is the one a search over all choices would take."""
    rng = np.random.default_rng(2)
    p = packing.Packer(0, capacity=16, levels=levels)
    step, before = 16 // levels, Counter()
    for i in range(800):
        size, done = int(rng.integers(1, 16)), sum(p.made.values())
        fills = sorted(f for mine in p.open for f, _ in mine)
        lack = sum(16 - f for f, _ in p.short)
        p.add(i, b"\0" * 4 * size)
        if size <= lack:
            continue
        size -= lack
        grade = lambda f: -(-f // step)

        def squares(fills):
            n = Counter(grade(f) for f in fills)
            return sum(c * c for level, c in n.items() if level < levels)

        after = sorted(f for mine in p.open for f, _ in mine)
        lasts = {grade(f): f for f in before} if before else {}
        choices = [squares([*fills, size])]
        for f in set(fills):
            if f + size <= 16 and (levels == 16 or lasts.get(grade(f), f) == f):
                left = list(fills)
                left.remove(f)
                choices.append(squares([*left, f + size]))
        assert squares(after) <= min(choices) or levels != 16, (fills, size, after)
        assert levels == 16 or squares(after) <= squares([*fills, size])
        assert [int(c) for c in p.level[1:levels]] == [sum(grade(f) == x for f in after) for x in range(1, levels)] and p.level[0] == p.level[levels] == 0
        before = {m[-1][0]: 1 for m in p.open if m}
        assert sum(p.made.values()) >= done
    p.close_out()
    assert all(s == 16 or s & (s - 1) == 0 for s in lengths(p.take()).values())


def test_windows_are_completed_by_the_rule():
    """Nearly all windows are filled by the rule, open ones stay few, and no more than ``most_open`` where sizes don't fit."""
    rng = np.random.default_rng(4)
    p, most = packing.Packer(0), 0
    sizes = np.minimum(np.exp(rng.normal(6.2, 1.1, 6000)).astype(int) + 1, 60_000)
    for i, size in enumerate(sizes.tolist()):
        p.add(i, b"\0" * 4 * size)
        most = max(most, int(p.level.sum()) + len(p.short))
    before = dict(p.made)
    p.close_out()
    total = sum(p.made.values())
    assert before["evicted"] == 0 and most <= 150 and p.made["closed"] <= 0.03 * total, (p.made, most)
    assert sum(lengths(p.take()).values()) == sizes.sum()
    p = packing.Packer(0, most_open=40)
    for i in range(500):  # no two fit in one window
        p.add(i, b"\0" * 4 * 2500)
        assert p.level.sum() <= 40
    evicted = p.made["evicted"]
    p.close_out()
    found = lengths(p.take())
    assert evicted > 200 and sum(found.values()) == 500 * 2500 and sum(s != 4096 for s in found.values()) <= 12


def test_pipeline(spark):
    from test_dedup import brute, lowered

    from tessera.llm import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    w = quality.train(quality.sample(docs, spark.read.parquet(f"{SF}/labels.parquet"), "quality", 2000), 3)
    good = [(r.doc_id, r.text) for r in docs.collect() if quality.score(r.text or "", w) >= 0.3]
    last = {}
    for doc, text in sorted(good):
        last[lowered(text)] = (doc, text)
    classes = {doc: c for doc, c, _, _ in brute(sorted(last.values()))}
    want = [(doc, text) for doc, text in last.values() if classes[doc] == doc]
    assert sorted({r.doc_id for r in got}) == sorted(d for d, _ in want)
    check_packed(got, want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_copies", "near_copies", "mixture", "packing"]


def test_stages_on_odd_rows(spark, tricky, empty):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (tricky, empty):
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() <= max(len(TRICKY), 2000)


def test_packing_keeps_the_mixture(spark, tmp_path):
    """Sequences rise with the mixture though its files differ in size, by which Spark deals them."""
    rows = [(i, "word " * (1 + (i * 7919) % 40) ** 2, f"s{i % 3}" if i < 300 else "hot") for i in range(900)]
    docs = table(spark, rows)
    corpus_pipeline.mixture(spark, docs, SF).write.parquet(str(tmp_path / "m"))
    at = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    tasks = defaultdict(set)
    for r in corpus_pipeline.packing(spark, spark.read.parquet(str(tmp_path / "m")), SF).collect():
        tasks[r.sequence_id >> 33].add(at[r.doc_id])
    spans = [(min(tasks[t]), max(tasks[t])) for t in sorted(tasks)]
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)), spans
    sized = tmp_path / "sized"
    for i, n in enumerate([5, 40, 300, 20, 200, 10, 100, 400]):
        table(spark, [(1000 * i + j, "x y z " * 30) for j in range(n)], 1).sort("doc_id").coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
        sized.mkdir(exist_ok=True)
        next((tmp_path / f"f{i}").glob("*.parquet")).rename(sized / f"part-{i:05d}-x.parquet")
    tasks = defaultdict(set)
    for r in corpus_pipeline.packing(spark, spark.read.parquet(str(sized)), SF).collect():
        tasks[r.sequence_id >> 33].add(r.doc_id)
    spans = [(min(tasks[t]), max(tasks[t])) for t in sorted(tasks)]
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)), spans


def test_mixing_many_sources(spark):
    """More sources than 1,024 slots get a longer cycle."""
    got = mixing.mix(table(spark, [(i, "x", f"s{i % 1030}") for i in range(1100)])).collect()
    assert sorted(r.position for r in got) == list(range(1100))
    weights = {r.source: r.weight for r in got}
    assert len(weights) == 1030 and sum(weights.values()) == 2048 and min(weights.values()) >= 1
