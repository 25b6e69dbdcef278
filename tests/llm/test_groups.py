"""SimHash, components, exact top-k, the mix and image copies, against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codelode.llm import components, media, mix, queries, simhash, topk
from codelode.llm.common import splittable


def roots(n, links):
    of = list(range(n))

    def find(a):
        while of[a] != a:
            of[a] = of[of[a]]
            a = of[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, x) for x in range(501, 560)] + [(7, 7)]
    want = roots(600, edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: want[x] for x in touched}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_components_deal_edges_twice(spark, monkeypatch):
    """With many partitions and few edges the files and tasks of exchanges are most of the cost."""
    kind = type(spark.range(1))
    plans, kept = [], kind.checkpoint

    def checkpoint(self, *more):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return kept(self, *more)

    monkeypatch.setattr(kind, "checkpoint", checkpoint)
    edges = [(i, i // 3) for i in range(1, 90)] * 2
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(90), 0)
    assert 2 <= len(plans) <= 6 and all(p.count("Exchange hashpartitioning") <= 2 and "Join" not in p for p in plans)


def print64(text, words=4):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(docs):
    p = [print64(t) for _, t in docs]
    links = [(i, j) for i in range(len(p)) for j in range(i) if (p[i] ^ p[j]).bit_count() <= 4 and docs[i][0] is not None and docs[j][0] is not None]
    r = roots(len(p), links)
    least = {}
    for (i, _), k in zip(docs, r, strict=True):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    return sorted(((-1 if i is None else i), f"{x:016x}", (-1 if i is None else least[k])) for (i, _), x, k in zip(docs, p, r, strict=True))


@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_joins_with_aggregates_split_hot_keys(spark, kind):
    small = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000", "adaptive.skewJoin.skewedPartitionFactor": "2", "adaptive.advisoryPartitionSizeInBytes": "20000"}
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(f"spark.sql.{k}", v)
        key = F.when(F.col("id") % 3 == 0, -7).otherwise(F.col("id")).cast("string")
        rows = spark.range(60_000, numPartitions=8).select(key.cast(kind).alias("k"), F.col("id").alias("v"))
        least = rows.groupBy("k").agg(F.min("v").alias("m"))
        joined = rows.join(splittable(least, "k"), "k").groupBy("m", "v").count()
        assert {(r.m, r.v) for r in joined.collect()} == {(0 if v % 3 == 0 else v, v) for v in range(60_000)}
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)


def test_simhash_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(base)]
    for k in range(150):
        t = rng.choice(base[:6]).split()
        t[rng.randrange(len(t))] = "edited"
        docs.append((1000 + k, " ".join(t)))
    docs += [(5000, None), (4000, ""), (4500, "\t\n"), (0, base[0]), (0, base[1]), (None, base[2]), (6000, "A B"), (6001, "a  b"), (6002, "X" * 10 + " " + "y " * 5000)]
    d = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, fingerprint string")
    got = sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in simhash.grouped(d).collect())
    assert got == brute_groups(docs)
    assert simhash.grouped(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.grouped(d, radius=5)


@pytest.mark.parametrize("direct", [True, False])
def test_tiles_lose_no_link(spark, direct):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    prints = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 63, (700, 3), dtype=np.uint64), axis=1) for c in centre]))
    rows = [(7, int(x).bit_count(), int(np.int64(x.view(np.int64))), int(x).to_bytes(8, "little")) for x in prints]
    d = spark.createDataFrame(rows, "cell long, pc long, node long, print binary")
    old = simhash.TILE, simhash.GROUP
    simhash.TILE, simhash.GROUP = 100, 2
    try:
        found = {tuple(sorted(r)) for r in _with_small_tiles(d, direct)}
    finally:
        simhash.TILE, simhash.GROUP = old
    n = [r[2] for r in rows]
    at = {x: i for i, x in enumerate(n)}
    near = np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None]) <= 4, 1))
    assert all((prints[at[a]] ^ prints[at[b]]).item().bit_count() <= 4 for a, b in found)
    assert roots(len(n), [(at[a], at[b]) for a, b in found]) == roots(len(n), near.tolist())
    assert len(found) < 20 * len(n) < len(near)


def _with_small_tiles(d, direct):
    """Runs links() in this process's workers with small tiles: the sizes travel in a copy of the module's globals."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(simhash)
    try:
        return simhash.links(d, 4, 64, direct).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(simhash)


@pytest.mark.parametrize("equal", [2, 3, 4, 6])
def test_near_prints_share_a_cell(spark, equal):
    rng = np.random.default_rng(equal)
    pairs = []
    for _ in range(200):
        x = int(rng.integers(0, 2**64, dtype=np.uint64))
        y = x
        for b in rng.choice(64, 4, replace=False).tolist():
            y ^= 1 << b
        pairs.append(tuple(v - 2**64 if v >= 2**63 else v for v in (x, y)))
    d = spark.createDataFrame(pairs, "x long, y long")
    cells = lambda c: F.array(*simhash.block_cells(F.col(c), 4, equal))
    got = d.select(F.arrays_overlap(cells("x"), cells("y")).alias("met"), F.size(F.array_distinct(cells("x"))).alias("n")).collect()
    assert all(r.met for r in got) and {r.n for r in got} == {len(simhash.block_cells(F.col("x"), 4, equal))}
    assert [simhash.blocks_for(n, 4) for n in (10, 10**9, 10**11)] == [2, 3, 5]


def test_no_prefilter_loses_a_near_pair():
    a = np.zeros((1, 32), np.uint64)
    b = a.copy()
    b[0, :2] = np.uint64(2**60 - 1)  # 120 of 2048 bits, all among the first 128
    assert simhash.near(a, b, 310).all() and not simhash.near(a, b, 119).any()


def test_bands_find_similar_sets():
    """Recall of the bands alone at a similarity of 0.8, over many pairs."""
    rng = np.random.default_rng(11)
    missed = 0
    for n in (5, 10, 45, 300) * 100:
        shared, own = rng.integers(0, 2**63, n * 8 // 10, dtype=np.uint64), n - n * 8 // 10
        a = np.concatenate([shared, rng.integers(0, 2**63, own, dtype=np.uint64)])
        missed += not np.intersect1d(simhash.bands(a), simhash.bands(shared)).size
    assert missed == 0


def test_similar_groups(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    texts = {i: [rng.choice(words) for _ in range(200)] for i in range(30)}
    for i in range(10):
        copy = list(texts[i])
        copy[50] = "edited"
        texts[100 + i] = copy  # 5 of 196 shingles differ
        texts[200 + i] = copy[:100] + texts[i + 10][100:]  # half of another
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()] + [(300, None), (301, ""), (400, "one two"), (None, "one two")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(d).collect()}
    assert all(got[100 + i] == i for i in range(10)) and all(got[200 + i] == 200 + i for i in range(10))
    assert all(got[i] == i for i in range(30)) and got[301] == 300 and got[400] == 400 and got[None] is None


def test_similar_groups_are_exact(spark):
    """Sets at the edge of the similarity, small ones above all, against exact Jaccard similarities."""
    rng = random.Random(9)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for a, b, shared in [(6, 7, 6), (5, 6, 5), (4, 5, 4), (12, 15, 12), (16, 19, 16), (20, 25, 20), (6, 8, 6), (4, 6, 4), (45, 50, 42), (24, 26, 22), (450, 450, 400), (450, 450, 399), (3, 4, 3)]:
        for _ in range(8):
            t = new(shared + 4)  # so many shingles, which both texts share
            texts += [" ".join(t + new(a - shared)), " ".join(t + new(b - shared))]
    sets = [frozenset(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in texts]
    exact = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 10 * len(a & b) >= 8 * len(a | b)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(d).collect()}
    assert [got[i] for i in range(len(texts))] == roots(len(texts), exact)


def test_candidates_are_confirmed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART_BYTES", 2000)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(45, 61)], rng.integers(0, 2**63, rng.integers(0, 7), dtype=np.uint64)])) for _ in range(80)]
    rows = [(1, int(np.floor(np.log(len(h)) / np.log(1.25) + 1e-9)), i, len(h), h.tobytes()) for i, h in enumerate(sets)]
    found = [tuple(r) for r in simhash.confirmed(spark.createDataFrame(rows, "root long, cell long, node long, n long, set binary"), 0.8).collect()]
    like = lambda i, j: 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j]))
    assert found and all(like(a, b) for a, b in found)
    assert roots(80, found) == roots(80, [(i, j) for i in range(80) for j in range(i) if like(i, j)])


# --- top-k ----------------------------------------------------------------------------------------


def brute_topk(rows, k):
    ok = [(i, np.floor(np.array(v, dtype=float) * 256).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, width - len(v)))) for i, v in ok]
    out = set()
    for q, v in {i: v for i, v in ok if i % 50 == 0}.items():
        best = sorted((-int(v @ u), i) for i, u in ok if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(12) * rng.choice([0.1, 1, 5])).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[10][1]) for i in range(400)]  # ties
    rows += [(9000, None), (9050, [float("nan")] * 12), (9051, [None] * 12), (9052, [float("inf")] * 12), (None, rows[0][1]), (9100, []), (9101, [1.0]), (9102, [0.0] * 12)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    rows = [(r.vec_id, r.embedding) for r in d.collect()]
    got = [tuple(r) for r in topk.top_k(d, F.col("vec_id") % 50 == 0).collect()]
    assert set(got) == brute_topk(rows, 5) and len(got) == len(set(got))
    few = d.where("vec_id in (0, 1, 2)")
    assert {tuple(r) for r in topk.top_k(few, F.col("vec_id") % 50 == 0).collect()} == brute_topk([r for r in rows if r[0] in (0, 1, 2)], 5)
    assert topk.top_k(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_with_values_beyond_a_long(spark):
    rows = [(0, [1e9, 1e9]), (1, [1e9, 1.0]), (2, [2e9, 3.0]), (3, [-1e9, 0.0]), (4, [-3e38, 1.0]), (5, [3e38, 0.5]), (6, [0.1, 0.2]), (50, [1.0, 2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in d.collect()]
    exact = lambda v: [int(np.floor(x * 256)) for x in v]
    want = []
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(exact(dict(rows)[q]), exact(v), strict=True)), i) for i, v in rows if i != q)
        want += [(q, n + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(d, F.col("vec_id") % 50 == 0, k=9).collect()) == want


def exact_topk(rows, k):
    """As brute_topk, with Python's integers."""
    whole = lambda v: [int(np.floor(np.float64(x) * 256)) for x in v]
    ok = [(i, whole(v)) for i, v in rows if all(np.isfinite(np.float64(x) * 256) for x in v)]
    out = set()
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, u, strict=True)), i) for i, u in ok if i != q)[:k]
            out |= {(q, n + 1, i, min(max(-x, -(2**63)), 2**63 - 1)) for n, (x, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("top", [1e9, 1e14, 1e80, 1e200, 1.7e308])
def test_topk_with_numbers_of_any_size(spark, top):
    """Few or many numbers up to the largest of a double, beside small ones, zeros and ties."""
    rng = np.random.default_rng(11)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    for i in range(0, 300, 7):
        rows[i][1][rng.integers(0, 6)] *= top / 4
    rows += [(1000 + i, [top * s, 1.0, 0.0, 0.0, 0.0, top]) for i, s in enumerate((1, -1, 1, 0.5, 1 / 512))] + [(1050, [0.0] * 6), (1100, [0.1] * 6), (1150, [top / 512] * 6)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(d, F.col("vec_id") % 50 == 0).collect()]
    assert set(got) == exact_topk(rows, 5) and len(got) == len(set(got))


def test_products_of_large_numbers_take_little_longer():
    import time

    rng = np.random.default_rng(2)
    a = np.floor(rng.standard_normal((256, 64)) * 256)
    a[3, 5] = 1e14 * 256
    start = time.time()
    got = topk.products(a, a[:250])
    assert time.time() - start < 0.2
    assert all(got[i, j] == sum(int(x) * int(y) for x, y in zip(a[i], a[j], strict=True)) for i in (0, 3, 200) for j in (0, 3, 249))


def test_queries_reach_only_groups_that_matter(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 300)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(6) * (20 if i < 400 else 0.01)).tolist()) for i in range(3000)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in d.collect()]
    assert {tuple(r) for r in topk.top_k(d, F.col("vec_id") % 50 == 0).collect()} == brute_topk(rows, 5)


def test_large_products_are_exact():
    a = np.array([[2.0**40 + 1, 3.0]])
    assert topk.products(a, a)[0][0] == (2**40 + 1) ** 2 + 9


# --- mix ------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return out


def mixed_docs(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "Z", "é", None]), " ".join(["w"] * int(rng.paretovariate(0.9) * 5))[:1_200]) for i in range(600)]
    rows += [(601, "empty", ""), (602, "empty", None), (603, "tiny", "one"), (None, "b", "x y"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, source string, text string, size string"), rows


def test_mix(spark):
    d, rows = mixed_docs(spark)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    m = mix.mix(d, block_words=200, shard_words=2000).cache()
    got = m.collect()
    assert len(got) == len(rows) and set(m.columns) == {"doc_id", "source", "text", *mix.ADDED}
    taken = Counter()
    for r in got:
        assert r["size"] == len((r.text or "").split()) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] and r.taken <= 3 * r["size"] and len(r.shards) == r.copies
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(5, 0.02 * want[s]), s
    again = mix.mix(d.repartition(3), block_words=200, shard_words=2000)
    assert sorted(map(str, again.drop("text").collect())) == sorted(map(str, m.drop("text").collect()))
    words = Counter()
    for r in got:
        for s in r.shards:
            words[s] += r["size"]
    assert len(words) > 5
    out = mix.emit(m, ["doc_id", "source"])
    assert Counter((r.doc_id, r.source) for r in out.collect()) == Counter({k: n for k, n in sum((Counter({(r.doc_id, r.source): r.copies}) for r in got), Counter()).items()})
    assert mix.mix(d.limit(0)).count() == 0


def brute_draw(rows, targets, names, block_words, shard_words, least, seed=42):
    """Shards of each (source, drawn), by a plain walk: quotas, the whole tree, permuted draws."""
    from pyspark.sql.types import LongType

    blocks, held = {}, {}
    for source, size, u, order in rows:
        blocks.setdefault((names.index(source), u), [0, order, source])[0] += size
    draws = {}
    for t, source in enumerate(names):
        own = sorted((o >> 52, w.bit_length() or 1, o, b, w) for (turn, b), (w, o, _) in blocks.items() if turn == t)
        size = sum(x[4] for x in own)
        base = min(int(targets[source] // size), 3) if size else 0
        left = targets[source] - base * size if base < 3 else 0
        by_cell = Counter()
        for k, c, _, _, w in own:
            by_cell[k, c] += w
        more = set()
        for cell in sorted(by_cell):
            if 0 < by_cell[cell] <= left:
                more.add(cell)
                left -= by_cell[cell]
        signed = lambda o: o - 2**64 if o >= 2**63 else o
        own.sort(key=lambda x: (x[0], x[1], signed(x[2]), x[3]))
        draws[t] = [x[3] for x in own] * base + [x[3] for x in own if x[:2] in more]
    quotas = np.array([len(draws[t]) for t in range(len(names))])
    shards = max(1, -(-int(np.ceil(sum(targets.values()))) // shard_words))

    def split(a, b, own, begin):
        if b - a == 1:
            for t, n in enumerate(own):
                q = len(draws[t])
                if n:
                    x, c = mix.permutation(q, seed + t)
                    for d, block in enumerate(draws[t]):
                        if begin[t] <= (x * d + c) % q < begin[t] + n:
                            held.setdefault((t, block), []).append(a)
            return
        m = (a + b) // 2
        some = np.flatnonzero(own)
        left = np.zeros_like(own)
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, a, b])))
        left[some] = rng.multivariate_hypergeometric(own[some], int(own.sum()) * (m - a) // (b - a), method="marginals")
        split(a, m, left, begin)
        split(m, b, own - left, begin + left)

    split(0, shards, quotas, np.zeros_like(quotas))
    return held


def test_draws_equal_brute_force(spark):
    d, rows = mixed_docs(spark)
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s))
    got = mix.mix(d, block_words=200, shard_words=2000).collect()
    targets = {r.source: r.target for r in got}
    blocks = {s: max(-(-sum(r["size"] for r in got if r.source == s) // 200), mix.LEAST_BLOCKS) for s in names}
    keyed = [(names.index(r.source), r.drawn % blocks[r.source]) for r in got]
    hashes = spark.createDataFrame(sorted(set(keyed)), "turn long, block long").select("turn", "block", F.xxhash64(F.lit(42), "turn", "block").alias("h")).collect()
    order = {(r.turn, r.block): r.h % 2**64 for r in hashes}
    held = brute_draw([(r.source, r["size"], k[1], order[k]) for r, k in zip(got, keyed, strict=True)], targets, names, 200, 2000, mix.LEAST_BLOCKS)
    assert [r.shards for r in got] == [sorted(held.get(k, [])) for k in keyed]
    assert any(len(r.shards) > 1 for r in got) and any(not r.shards for r in got)


def test_sources_that_share_a_colour(spark, monkeypatch):
    monkeypatch.setattr(mix, "COLOURS", 2)
    monkeypatch.setattr("codelode.llm.common.MOST_BROADCAST", 0)
    d, rows = mixed_docs(spark)
    got = mix.mix(d, block_words=200, shard_words=2000).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == len(r.shards) * r["size"] <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= max(5, 0.02 * t) for s, t in target.items()) and len(target) > 6


def test_mix_fills_the_gap_behind_long_documents(spark):
    rng = random.Random(8)
    rows = [(i, s, " ".join(["w"] * rng.randint(20, 100))) for s in "abc" for i in range(ord(s) * 1000, ord(s) * 1000 + 300)]
    rows += [(n, s, " ".join(["w"] * 20_000)) for n, s in enumerate("aaabbbccc")]
    rows += [r for r in rows[:300:3] for _ in range(2)]  # repeated rows are given together
    got = mix.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for s in "abc":
        own = [r for r in got if r.source == s]
        copies = {}
        for r in own:
            assert copies.setdefault(r.doc_id, r.copies) == r.copies
        off = own[0].target - sum(r.taken for r in own)
        # nothing that could be given once more fits what is missing
        block = Counter()
        for r in own:
            block[r.drawn % mix.LEAST_BLOCKS] += r["size"] if r.copies == min(copies.values()) else 0
        assert 0 <= off < min(w for w in block.values() if w)


def test_tree_meets_quotas():
    quotas = np.array([1000, 300, 7, 0])
    t = list(mix.leaves(quotas, 13, 1, 0, 13))
    per, begins = np.zeros((13, 4), int), np.zeros(4, int)
    for shard, colours, begin, own in t:
        assert (begin == begins[colours]).all() and (own > 0).all()
        per[shard, colours] = own
        begins[colours] += own
    assert (per.sum(0) == quotas).all() and per.sum(1).max() - per.sum(1).min() <= 4 and abs(per[:, 0] - 1000 / 13).max() < 30
    part = list(mix.leaves(quotas, 13, 1, 4, 9))
    assert str(part) == str(t[4:9])
    for n in (1, 2, 97, 100):
        a, c = mix.permutation(n, 3)
        assert sorted((a * x + c) % n for x in range(n)) == list(range(n))


# --- media ----------------------------------------------------------------------------------------


def png(image):
    import struct

    h, w = image.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(bytes([i % 5]) + _filtered(image, i) for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def _filtered(image, y):
    line = image[y].astype(int)
    up = image[y - 1].astype(int) if y else np.zeros_like(line)
    left = np.concatenate([[0], line[:-1]])
    corner = np.concatenate([[0], up[:-1]])
    p = left + up - corner
    best = np.stack([abs(p - left), abs(p - up), abs(p - corner)]).argmin(0)
    paeth = np.choose(best, [left, up, corner])
    return ((line - [0 * line, left, up, (left + up) // 2, paeth][y % 5]) % 256).astype(np.uint8).tobytes()


def picture(seed, h=140, w=160):
    rng = np.random.default_rng(seed)
    rough = rng.integers(0, 256, (h // 5 + 1, w // 5 + 1))
    return np.kron(rough, np.ones((5, 5)))[:h, :w].astype(np.uint8)


def test_images_decode():
    x = picture(1, 23, 31)
    assert (media.decode(png(x)) == x).all() and (media.decode(media.encode(x)) == x).all()
    for bad in (None, b"", b"P5 9 9 255\n", b"GIF89a", b"\x89PNG\r\n\x1a\n123", b"P5 x"):
        assert media.decode(bad) is None


def test_copies_are_found_cropped_edited_and_turned(spark):
    a, b = picture(1), picture(2)
    edited = a.copy()
    edited[40:90, 40:100] = picture(3)[40:90, 40:100]
    rows = [(1, a), (2, a[20:, 30:]), (3, edited), (4, b), (5, np.rot90(b)), (6, picture(4)), (7, np.kron(b, np.ones((2, 2), np.uint8))), (8, np.zeros((50, 50), np.uint8)), (9, a[:5, :5]), (2, a[20:, 30:])]
    d = spark.createDataFrame([(i, media.encode(x) if i % 2 else png(x), "c") for i, x in rows] + [(10, None, ""), (11, b"no image", ""), (None, media.encode(a), "")], "image_id long, image binary, component_id string")
    got = [(r.image_id, r.component_id) for r in media.copies(d).collect()]
    assert len(got) == 13
    found = dict(got)
    assert {k: found[k] for k in (1, 2, 3)} == {1: 1, 2: 1, 3: 1} and found[4] == found[5] == found[7] == 4
    assert all(found[k] == k for k in (6, 8, 9, 10, 11)) and found[None] is None
    assert media.copies(d.limit(0)).count() == 0


def test_small_images_have_points_and_equal_ones_link(spark):
    rng = np.random.default_rng(12)
    small = [rng.integers(0, 200, (h, 64)).astype(np.float32) for h in (1, 2, 5, 9, 14)]
    one = [np.full((h, 3), 9, np.float32) for h in (1, 2)]  # without any corner
    images = [encoded for a in small + one for encoded in (media.encode(a), png(a.astype(np.uint8)))] + [None, None, b"no", b"no"]
    edited = small[4].copy()
    edited[3, 20] = 255
    images.append(media.encode(edited))
    d = spark.createDataFrame(list(enumerate(images)), "image_id long, image binary")
    got = {r.image_id: r for r in media.copies(d).collect()}
    assert [got[i].component_id for i in range(19)] == [i // 2 * 2 for i in range(14)] + [14, 15, 16, 17, 8]
    assert all(got[i].n_points > 0 for i in range(10)) and all(got[i].n_links == 1 for i in (0, 1, 12, 13))


def test_images_described_together_are_as_alone():
    rng = np.random.default_rng(13)
    images = [picture(i, int(rng.integers(1, 90)), 64).astype(np.float32) for i in range(20)] + [picture(50, 70, 31).astype(np.float32), np.zeros((0, 0))]
    for (w, p), image in zip(media.describe_all(images), images, strict=True):
        alone = media.describe(image)
        assert (w == alone[0]).all() and (p == alone[1]).all()
    assert sum(len(w) for w, _ in media.describe_all(images)) > 100


def test_common_words_hide_no_copies(spark):
    """Images 50 and 90 share 12 points; each of these is in a smaller image of its own too."""
    rng = np.random.default_rng(14)
    word = lambda n: rng.integers(-(2**63), 2**63, (n, 2))
    shared = word(12)
    spot = lambda n, d=0: [[0, 0, 20 * i + d, 7 * i + d] for i in range(n)]
    rows = [(50, np.concatenate([shared, word(5)]), spot(17)), (90, np.concatenate([shared, word(9)]), spot(21, 3))]
    rows += [(i, np.concatenate([shared[i : i + 1], word(6)]), spot(7)) for i in range(12)]
    d = spark.createDataFrame([(i, len(w), w.reshape(-1).tolist(), [x for p in q for x in p], None) for i, w, q in rows], media.POINTS)
    assert [tuple(r) for r in media.links(d).collect()] == [(90, 50)]


def test_words_of_many_images_keep_copies_together(spark):
    rng = np.random.default_rng(15)
    word = lambda n: rng.integers(-(2**63), 2**63, (n, 2))
    common, own = word(4), [word(20) for _ in range(30)]
    spot = lambda n, d: [[0, 0, int(rng.integers(0, 500)) if i < 4 else 20 * i + d, 7 * i + d] for i in range(n)]
    rows = [(100 * k + i, np.concatenate([common, own[i], word(3)]), spot(27, 5 * k)) for k in (0, 1, 2) for i in range(30)]
    d = spark.createDataFrame([(i, len(w), w.reshape(-1).tolist(), [x for p in q for x in p], None) for i, w, q in rows], media.POINTS)
    found = {tuple(r) for r in media.links(d).collect()}
    assert roots(300, found) == [i % 100 if i % 100 < 30 else i for i in range(300)]


def brute_votes(rows):
    """Pairs whose points agree, by votes of all holders of each word and by descriptors."""
    found = set()
    for n, (i, w, q) in enumerate(rows):
        for j, v, r in rows[:n]:
            here, there = set(), media.packed_place(*np.array(r).T)
            bits = lambda x: [(lambda y: [y & (2**43 - 1), y >> 43 & (2**43 - 1), y >> 86])(int(a) % 2**64 + (int(b) % 2**64 << 64)) for a, b in x]
            for x, p in zip(bits(w), media.packed_place(*np.array(q).T), strict=True):
                for y, at in zip(bits(v), there, strict=True):
                    if any(s == t for s, t in zip(x, y, strict=True)):
                        here.add((int(p), *(int(z[0]) for z in media.shifted(np.array([p]), np.array([at])))))
            votes = max(Counter((m, x + a, y + b) for _, m, x, y in here for a in (0, 1) for b in (0, 1)).values(), default=0)
            if votes >= media.VOTES or votes >= media.FEW and media.consensus(w, np.array(q), v, np.array(r)) >= media.VOTES:
                found.add((i, j))
    return found


@pytest.mark.parametrize("side", [1024, 3])
def test_all_holders_of_common_words_are_heard(spark, monkeypatch, side):
    """12 points that each of 40 images holds, at places of its own but for a few images, whose places agree; and two that share 4
    of the points and 5 that differ by some bits."""
    monkeypatch.setattr(media, "SIDE", side)
    rng = np.random.default_rng(17)
    word = lambda n: rng.integers(-(2**63), 2**63, (n, 2))
    common, near = word(12), word(5)
    rows = []
    for i in range(40):
        kept = rng.permutation(12)[:9] if i % 5 else np.arange(12)
        spots = [[0, 0, 40 * int(k) + 5 * i, 9 * int(k)] if i in (7, 18, 25, 31, 33) else [0, 0, int(rng.integers(0, 2000)), int(rng.integers(0, 2000))] for k in kept]
        rows.append((i + 1, np.concatenate([common[kept], word(3)]), spots + [[0, 0, 3000 + i, 3000]] * 3))
    flip = np.array([[1 << 5 | 1 << 50, 1 << 3 | 1 << 40]] * 5)
    for i, other in ((50, near), (51, near ^ flip)):
        rows.append((i, np.concatenate([common[:4], other]), [[0, 0, 30 * k + i, 11 * k] for k in range(9)]))
    d = spark.createDataFrame([(i, len(w), w.reshape(-1).tolist(), [int(x) for p in q for x in p], None) for i, w, q in rows], media.POINTS)
    want = brute_votes(rows)
    assert len(want) >= 11 and (51, 50) in want
    found = {tuple(r) for r in media.links(d).collect()}
    assert found <= want and roots(60, found) == roots(60, want)


def test_only_pairs_that_agree_leave_the_count_of_common_words(spark, monkeypatch):
    """30 images hold 8 points at places of their own: votes of all pairs, of which one pair's agree, make one row."""
    rng = np.random.default_rng(23)
    common, rows = rng.integers(-(2**63), 2**63, (8, 2)), []
    for i in range(30):
        spots = [[0, 0, (1 << 19) + 90 * k + i, 11 * k] if i in (11, 27) else [0, 0, *rng.integers(0, 1 << 19, 2).tolist()] for k in range(8)]
        rows.append((i, common.reshape(-1).tolist(), [x for q in spots for x in q]))
    made, kept = [], media.crossing
    monkeypatch.setattr(media, "crossing", lambda *x: made.append(kept(*x)) or made[0])
    monkeypatch.setattr(media, "CLOSE", 0)
    found = media.links(spark.createDataFrame([(i, 8, w, q, None) for i, w, q in rows], media.POINTS)).collect()
    assert {tuple(r) for r in found} == {(27, 11)}
    assert made[0].count() == 1


def brute_links(images):
    """Pairs with a consensus, by comparing the descriptors of all pairs."""
    points = {}
    for i, x in images:
        w, p = media.describe(x.astype(np.float32))
        _, at, times = np.unique(w, axis=0, return_index=True, return_counts=True)
        keep = np.sort(at[times == 1])
        points[i] = w[keep], p[keep]
    return {(a, b) for a in points for b in points if a > b and media.consensus(*points[a], *points[b]) >= media.VOTES}


def edits(x, rng):
    """What is done to a picture, by name."""
    patched = x.copy()
    patched[30:80, 30:90] = picture(int(rng.integers(10**6)), 50, 60)
    return {
        "crop": x[int(rng.integers(5, 40)) :, int(rng.integers(5, 40)) :], "patch": patched, "brighter": np.clip(x * 0.7 + 40, 0, 255).astype(np.uint8),
        "noise": np.clip(x + rng.normal(0, 4, x.shape), 0, 255).astype(np.uint8), "line": np.insert(x, 60, picture(int(rng.integers(10**6)), 7, x.shape[1]), axis=0),
    }


def test_recall_by_edit_and_brute_force(spark):
    rng = np.random.default_rng(16)
    images, made = [], {}
    for k in range(25):
        x = picture(1000 + k)
        images.append((100 * k, x))
        for n, (name, y) in enumerate(edits(x, rng).items()):
            images.append((100 * k + n + 1, y))
            made[100 * k + n + 1] = name
    d = spark.createDataFrame([(i, media.encode(x)) for i, x in images], "image_id long, image binary")
    got = {r.image_id: r.component_id for r in media.copies(d).collect()}
    exact = brute_links(images)
    at = {i: n for n, (i, _) in enumerate(images)}
    want = roots(len(images), [(at[a], at[b]) for a, b in exact])
    pairs = [(i, images[want[at[i]]][0]) for i, _ in images if want[at[i]] != at[i]]
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs) > 60
    recall = Counter(name for i, name in made.items() if got[i] == i // 100 * 100)
    print("recall by edit, of 25:", dict(recall))
    assert all(recall[name] >= 0.9 * 25 for name in made.values())
    assert all(c // 100 == i // 100 for i, c in got.items())


def brute_equal_pages(rows):
    least = {}
    for i, page in sorted(rows):
        least.setdefault(media.drawn(page or "").tobytes(), i)
    return {i: least[media.drawn(page or "").tobytes()] for i, page in rows}


def test_equal_pages_share_a_component(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").cast("long"), "html")
    twice = pages.union(pages.select(F.col("page_id") + 1_000_000, "html"))
    got = {r.image_id: r.component_id for r in media.copies(media.page_images(twice)).collect()}
    assert all(got[i] == got[b] for i, b in brute_equal_pages([tuple(r) for r in twice.collect()]).items())


def test_pages_are_drawn_whole():
    x = media.drawn("<head><title>no</title></head><p>" + "ab " * 100 + "</p><script>x</script><p>&eacute;</p>")
    assert x.shape == (6, 64) and media.drawn("").shape == (1, 64)


def test_whole_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.QUERIES["op5_simhash"](spark, sf).collect()) == brute_groups(docs)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {tuple(r) for r in queries.QUERIES["op6_topk"](spark, sf).collect()} == brute_topk(rows, 5)
    assert queries.QUERIES["op10_media"](spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()
