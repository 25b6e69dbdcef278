"""Operators on small hand-made frames, and properties against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode import schemas as S
from codelode.operators import chunking, editing, factored, graph, layout, parse, partitioning, ratelimit, search, stats, store, tasks, textindex
from codelode.plans import catalogue
from codelode.plans.adapters import Tables
from codelode.sources import files as file_source
from codelode.sources import git

NODE = "repo_id long, branch string, relative_path string, node_id string, node_type string, name string, parent_id string, depth int, start_line int, start_column int"


def nodes(spark, rows):
    return spark.createDataFrame([(1, b, p, i, t, n, None, 0, 1, 0) for b, p, i, t, n in rows], NODE)


def pairs(spark, rows):
    return spark.createDataFrame([(1, b, x, y) for b, x, y in rows], S.EDGES)


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- graph ----------------------------------------------------------------------------------------


def test_call_edges(spark):
    n = nodes(spark, [("m", "a.py", "f1", "function_definition", "f"), ("m", "b.py", "f2", "function_definition", "f"), ("x", "a.py", "f3", "function_definition", "f"), ("m", "a.py", "g", "function_definition", "g"), ("m", "a.py", "c", "call", "f"), ("m", "a.py", "none", "function_definition", None)])
    c = spark.createDataFrame([(1, "m", "g", "a.b.f"), (1, "m", "g", "f"), (1, "m", "f1", "f"), (1, "m", "g", "unknown")], S.CALLS)
    assert got(graph.call_edges(c, n), "branch", "caller", "callee") == [("m", "f1", "f1"), ("m", "f1", "f2"), ("m", "g", "f1"), ("m", "g", "f2")]


def test_dead_code_and_references(spark):
    n = nodes(spark, [("m", "a", "f", "function_definition", "f"), ("m", "a", "g", "class_declaration", "g"), ("m", "a", "x", "call", "f"), ("o", "a", "f", "function_definition", "f")])
    e = pairs(spark, [("m", "g", "f")])
    assert got(graph.dead_code(n, e), "branch", "node_id") == [("m", "g"), ("o", "f")]
    assert got(graph.dead_code(n, e, S.OUTLINE_TYPES), "branch", "node_id") == [("o", "f")]
    assert got(graph.symbol_references(n, e, "f"), "branch", "node_id") == [("m", "g")]
    assert got(graph.symbol_references(n, e, "nothing"), "node_id") == []


def test_central_nodes_and_counts(spark):
    n = nodes(spark, [("m", "a", k, "function_definition", k) for k in "abcdef"])
    e = pairs(spark, [("m", "a", "b"), ("m", "c", "b"), ("m", "a", "c"), ("m", "a", "d")])
    assert [tuple(r) for r in graph.central_nodes(n, e, 3).select("node_id", "calls_in").collect()] == [("b", 2), ("c", 1), ("d", 1)]
    assert tuple(graph.graph_counts(n, e).first()) == (6, 4)
    assert tuple(graph.graph_counts(n.limit(0), e.limit(0)).first()) == (0, 0)


def test_call_hierarchy_ends_in_cycles(spark):
    e = pairs(spark, [("m", "a", "b"), ("m", "b", "c"), ("m", "c", "a"), ("m", "c", "c")])
    roots = spark.createDataFrame([(1, "m", "a")], "repo_id long, branch string, node_id string")
    assert got(graph.call_hierarchy(e, roots, 9), "node_id", "level") == [("a", 0), ("b", 1), ("c", 2)]
    assert got(graph.call_hierarchy(e, roots, 9, callers=True), "node_id", "level") == [("a", 0), ("b", 2), ("c", 1)]


def test_trees(spark):
    rows = [(1, "m", "f", "r", "module", "r", None, 0, 1, 0), (1, "m", "f", "k2", "call", "k2", "r", 1, 9, 0), (1, "m", "f", "k1", "call", "k1", "r", 1, 3, 0), (1, "m", "f", "lost", "call", "lost", "gone", 1, 5, 0)]
    n = spark.createDataFrame(rows, NODE).withColumn("end_line", F.col("start_line"))
    assert got(graph.tree_paths(n), "node_id", "level", "path") == [("k1", 1, "r/k1"), ("k2", 1, "r/k2"), ("lost", 0, "lost"), ("r", 0, "r")]
    import json

    tree = json.loads(graph.nested_trees(n).first()["tree"])
    assert [x["id"] for x in tree] == ["r", "lost"] and [x["id"] for x in tree[0]["children"]] == ["k1", "k2"] and tree[0]["children_count"] == 2


def test_nodes_by_id_takes_one_per_line(spark):
    n = nodes(spark, [("m", "a", "y", "call", None), ("m", "a", "x", "call", None), ("m", "b", "z", "call", None)])
    ids = spark.createDataFrame([("x",), ("y",), ("z",)], "node_id string")
    assert got(graph.nodes_by_id(n, ids), "node_id") == [("x",), ("z",)]


# --- directories ----------------------------------------------------------------------------------


def greedy(cands):
    chosen = []
    for d, depth, cost in sorted(cands, key=lambda c: (c[2], c[1])):
        if not any(d == s or d.startswith(s + "/") for s in chosen):
            chosen.append(d)
    return sorted(chosen)


@pytest.mark.parametrize("seed", range(4))
def test_partition_choice_is_the_greedy_one(spark, seed):
    rng = random.Random(seed)
    paths = ["/".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + f"/f{i}.py" for i in range(120)] + ["top.py"]
    f = spark.createDataFrame([(p, 1) for p in paths], "relative_path string, size long")
    cands = partitioning.candidates(partitioning.dir_rollup(f), 3, 3, 10)
    rows = [(r["dir"], r["depth"], r["cost"]) for r in cands.collect()]
    chosen = partitioning.select_partitions(cands)
    assert sorted(r["dir"] for r in chosen.collect()) == greedy(rows)
    assigned = dict(partitioning.assign_partitions(f, chosen).collect())
    for p in paths:
        over = [d for d in greedy(rows) if p.startswith(d + "/")]
        assert assigned[p] == (max(over, key=len) if over else ".")


def test_partition_map_and_listing(spark):
    f = spark.createDataFrame([(f"src/core/f{i}.py", 10) for i in range(30)] + [("a.py", 1)], "relative_path string, size long")
    m = dict(partitioning.partition_map(f, "12345678-x").collect())
    assert m["a.py"] == "repo_12345678__root" and len(set(m.values())) == 2
    assert got(partitioning.list_dir(f), "entry") == [("a.py",), ("src/",)]
    assert got(partitioning.list_dir(f, "src"), "entry") == [("core/",)]
    assert got(partitioning.list_dir(f, "nothing"), "entry") == []


# --- search ---------------------------------------------------------------------------------------


def test_vector_search_and_duplicates(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [1.0, 0.01]), ("d", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("nan", [float("nan"), 1.0])]
    c = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    assert [r["chunk_id"] for r in search.vector_topk(c, [1.0, 0.0], 3).collect()] == ["a", "b", "c"]
    dup = search.duplicate_pairs(c, 0.98, None)
    assert got(dup, "id_a", "id_b") == [("a", "b"), ("a", "c"), ("b", "c"), ("d", "nan")]
    assert set(got(search.duplicate_pairs_lsh(c, 0.98, dim=2), "id_a", "id_b")) <= set(got(dup, "id_a", "id_b"))
    assert got(search.neighbours(c, 1), "id", "other")[:2] == [("a", "b"), ("b", "a")]
    assert search.neighbours(c.limit(0), 1).collect() == []


def vectors(spark, m, ids=None):
    return spark.createDataFrame([(str(i), v.tolist()) for i, v in zip(ids or range(len(m)), m, strict=True)], "chunk_id string, embedding array<double>").repartition(5)


def nearest(m, k, least):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    ids, out = [str(i) for i in range(len(m))], set()
    for i in range(len(m)):
        own = sorted(((-s[i, j], ids[j]) for j in range(len(m)) if j != i and s[i, j] >= least))
        out |= {(ids[i], other) for _, other in own[:k]}
    return out


@pytest.mark.parametrize(("k", "least"), [(5, -1.0), (3, 0.9), (None, 0.8), (None, 0.98), (1, 0.2)])
def test_neighbours_equal_brute_force(spark, k, least):
    """Clusters, lone vectors, opposite ones and copies, of which there are more than k."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 16))
    m = np.concatenate([centres[rng.integers(0, 12, 250)] + rng.standard_normal((250, 16)) * rng.choice([0.02, 0.2, 1], (250, 1)), rng.standard_normal((60, 16))])
    m = np.concatenate([m, m[:40], -m[:20], np.repeat(m[5:6], 12, 0)])
    assert set(got(search.neighbours(vectors(spark, m), k, least), "id", "other")) == nearest(m, k, least)


def test_parts_of_large_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = np.concatenate([np.ones((150, 8)) + rng.standard_normal((150, 8)) * 0.01, rng.standard_normal((50, 8))])
    monkeypatch.setattr(search, "BLOCK", 8)
    real = search.cells_of
    monkeypatch.setattr(search, "cells_of", lambda *x: (real(*x)[0], {c: 3 for c in range(50)}))
    for least in (0.5, 0.9):
        assert set(got(search.neighbours(vectors(spark, m), 4, least), "id", "other")) == nearest(m, 4, least)


def test_visits_do_not_grow_with_the_table(spark):
    """At 0.98 a vector visits as few cells among 25,000 as among 2,500, and the pairs that are compared are few of all."""
    rng, seen = np.random.default_rng(1), {}
    centres = rng.standard_normal((60, 24))
    for n in (2_500, 25_000):
        m = centres[rng.integers(0, 60, n)] + rng.standard_normal((n, 24)) * 0.15
        units = search._units(vectors(spark, m)).cache()
        blocks = search.placed(units, *search.cells_of(units, None, 0.98)).groupBy("grp", "kind").agg(F.sum(F.size("ids")).alias("n")).groupBy("grp").pivot("kind", [0, 1]).sum("n").na.fill(0)
        visits, compared = blocks.agg(F.sum("1"), F.sum(F.col("0") * F.col("1"))).first()
        seen[n] = visits / n, compared / n**2
        units.unpersist()
    assert seen[25_000][0] <= 1.1 * seen[2_500][0] < 3 and max(x[1] for x in seen.values()) < 0.1, seen


def test_blocks_of_a_table_that_no_bound_tells_apart(spark):
    """They are large, and a vector travels a bounded number of times."""
    units = search._units(vectors(spark, np.random.default_rng(2).standard_normal((20_000, 32)))).cache()
    blocks = search.placed(units, *search.cells_of(units, 5, -1.0)).select("kind", F.size("ids").alias("n"))
    rows, size = blocks.agg(F.sum("n"), F.avg("n")).first()
    units.unpersist()
    assert rows <= 2 * 8 * 20_000 and size > 512


@pytest.mark.parametrize("k", [1, 3])
def test_neighbours_among_copies_and_repeated_ids(spark, k):
    rng = np.random.default_rng(8)
    m = rng.standard_normal((30, 8))
    m = m[np.concatenate([np.arange(30), np.repeat(0, 40), np.repeat([1, 2], 9)])]
    ids = [str(i) for i in [*range(60), *rng.integers(0, 25, len(m) - 60)]]
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    want = []
    for x in set(ids):
        best = sorted((-s[i, j], ids[j]) for i in range(len(m)) if ids[i] == x for j in range(len(m)) if ids[j] != x)
        want += [(x, other) for _, other in best[:k]]
    odd = spark.createDataFrame([("inf", [float("inf")] * 8), ("none", [None] * 8), ("empty", []), ("null", None), ("zero", [0.0] * 8)], "chunk_id string, embedding array<double>")
    assert got(search.neighbours(vectors(spark, m, ids).union(odd), k), "id", "other") == sorted(want)


def test_text_index(spark, tmp_path):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcé İ1") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(80)] + ["", "ab", None, "ABC abc", "x" * 5000]
    f = spark.createDataFrame([(f"{i}.md" if i % 7 else f"{i}.bin", t) for i, t in enumerate(texts)], "relative_path string, content string").withColumn("blob_hash", F.sha2("content", 256))
    index = textindex.TextIndex(spark, f"{tmp_path}/index")
    assert index.holding(["abc"]).collect() == []
    index.update(f.limit(30))
    index.update(f)
    index.update(f)
    assert index.known().count() == index.texts().count() == f.where("content is not null").select("content").distinct().count()
    for asked in ([w] for w in [*words, " ABC ", "zzzz", "", "é", "x" * 40]):
        assert got(textindex.fulltext(index, f, asked), "relative_path") == got(search.fulltext(f, asked), "relative_path"), asked
    asked = ["abc", "x1", ""]
    assert got(textindex.fulltext(index, f, asked), "relative_path") == got(search.fulltext(f, asked), "relative_path")


def test_the_index_reads_few_contents(spark, tmp_path):
    from codelode.facade import Analysis

    folder = tmp_path / "code"
    folder.mkdir()
    for i in range(60):
        (folder / f"f{i}.py").write_text(f"def function_{i}():\n    return {i}\n")
    a = Analysis(spark, f"{tmp_path}/store")
    a.analyze_branch(str(folder), 1, "m")
    a.index_text(1, "m")
    (folder / "f60.py").write_text("def later():\n    return FUNCTION_7()\n")
    a.analyze_branch(str(folder), 1, "m")
    assert got(a.search_indexed_text(1, "m", ["Function_7("]), "relative_path") == got(a.search_files_for_text(1, "m", ["Function_7("]), "relative_path") == [("f60.py",), ("f7.py",)]
    assert a.text_index().candidates(["function_7("]).count() == 1
    read = a.text_index().holding(["function_7("])
    read.collect()
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "shard#" in plan.split("PartitionFilters")[1][:60]
    a.index_text(1, "m")
    assert a.text_index().known().count() == 61


def test_fulltext(spark):
    f = spark.createDataFrame([("a.md", "The Cat"), ("b.bin", "the cat"), ("c.py", "dog"), ("README", None)], "relative_path string, content string")
    for fn in (search.fulltext, search.fulltext_many):
        assert got(fn(f, [" CAT ", ""]), "relative_path") == [("a.md",)]
        assert got(fn(f, []), "relative_path") == []


def test_embedding_is_deterministic(spark):
    c = spark.createDataFrame([("a", "x y z"), ("b", "z y x"), ("c", None)], "chunk_id string, content string")
    v = {r["chunk_id"]: r["embedding"] for r in search.hashed_embedding(c, 16).collect()}
    assert v["a"] == v["b"] and sum(x * x for x in v["a"]) == pytest.approx(1) and set(v["c"]) == {0.0}


# --- statistics, tasks, limits --------------------------------------------------------------------


def test_statistics(spark):
    f = spark.createDataFrame([(1, "m", "a.py", "python", 10, "p"), (1, "m", "a.py", "python", 10, "p"), (1, "m", "b", None, None, "q")], "repo_id long, branch string, relative_path string, language string, line_count long, partition_name string")
    c = spark.createDataFrame([(1, "m", 5), (1, "m", None)], "repo_id long, branch string, token_count int")
    r = stats.repository_stats(f, c).first()
    assert (r.file_count, r.total_lines, r.total_tokens, r.schema_count, r.language_breakdown) == (2, 10, 5, 2, {"python": 1})
    assert stats.repository_stats(f.limit(0), c).count() == 0
    empty = spark.createDataFrame([], S.BILLING)
    assert tuple(stats.usage_totals(empty).first()) == (0, 0, 0.0)


def test_dominant_takes_the_least_on_a_tie(spark):
    d = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c")], "g int, v string")
    assert got(stats.dominant(d, ["g"], "v"), "g", "dominant") == [(1, "a"), (2, "c")]


def test_task_state(spark):
    log = spark.createDataFrame([(1, 1, 1, "running", "a", 5.0, {"x": "1"}), (1, 2, 2, None, None, 50.0, {"x": "2", "y": "3"}), (1, 3, 3, "failed", "bad", None, None), (2, 1, 1, "pending", None, None, None)], "task_id long, ts long, seq long, status string, message string, progress double, details map<string,string>")
    rows = {r.task_id: r for r in tasks.task_state(log).collect()}
    assert (rows[1].status, rows[1].progress, rows[1].details, rows[1].log_history) == ("failed", 100.0, {"x": "2", "y": "3"}, ["a", "bad"])
    assert (rows[2].status, rows[2].progress, rows[2].completed_at) == ("pending", 0.0, None)


def test_history(spark):
    t = spark.createDataFrame([(1, 1, None, "a", "completed", 1), (2, 1, None, "b", "running", 2), (3, 1, 2, "kid", "completed", 3), (4, 2, None, "c", "running", 9)], "task_id long, repo_id long, parent_id long, name string, status string, started_at long")
    page = tasks.history(t, 1, 0, 1).collect()
    assert [r.task_id for r in page] == [2] and page[0].children[0]["name"] == "kid"
    assert got(tasks.latest_task(t), "repo_id", "task_id") == [(1, 2), (2, 4)]
    with pytest.raises(ValueError):
        tasks.history(t, 1, -1)


def test_rate_limit_window(spark):
    r = spark.createDataFrame([("k", "m", s) for s in (0, 30, 60, 61)], "api_key string, model_name string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [x.in_window for x in ratelimit.window_counts(r, 60, ["api_key"]).orderBy("s").collect()] == [1, 2, 2, 3]
    limits = spark.createDataFrame([("m", 2, 60.0), ("other", 0, 60.0)], S.RATE_LIMITS)
    assert ratelimit.violations(r, limits).count() == 1


def test_limiter_never_admits_too_many():
    rng = random.Random(3)
    times = sorted(rng.uniform(0, 30) for _ in range(60))
    limits, keys = [(3, 5.0), (1, 0.5)], ["a", "b"]
    done = ratelimit.admit(times, limits, keys)
    assert len(done) == 60
    for k in keys:
        at = [t for key, t in done if key == k]
        for most, period in limits:
            for i, t in enumerate(at):
                assert sum(x > t - period for x in at[: i + 1]) <= most
    assert ratelimit.admit([0, 0, 0], [], keys) == [("a", 0)] * 3


# --- layout ---------------------------------------------------------------------------------------


def blocks(spark, rows):
    return spark.createDataFrame([(1, i, t, x, y, x + w, y + 10.0) for i, (t, x, y, w) in enumerate(rows)], "page int, block_id long, text string, x0 double, y0 double, x1 double, y1 double")


def test_layout(spark):
    b = blocks(spark, [("b", 100.0, 0.0, 20.0), ("a", 0.0, 2.0, 20.0), ("c", 0.0, 30.0, 20.0), ("x", 101.0, 31.0, 20.0)])
    assert [r.text for r in layout.reading_order(b).orderBy("position").collect()] == ["a", "b", "c", "x"]
    assert got(layout.columns(b), "text", "column_no") == [("a", 0), ("b", 1), ("c", 0), ("x", 1)]
    r = blocks(spark, [("same", 0.0, 0.0, 20.0), ("same", 1.0, 1.0, 20.0), ("same", 2.5, 0.0, 20.0), ("q", 9.0, 9.0, 20.0)])
    assert got(layout.without_repeats(r), "block_id") == [(0,), (2,)]
    m = blocks(spark, [("left", 0.0, 0.0, 20.0), ("right", 25.0, 1.0, 20.0), ("far", 90.0, 0.0, 20.0)])
    assert got(layout.merged(m), "text") == [("far",), ("left right",)]
    assert got(layout.word_groups(m), "text") == [("far",), ("left right",)]
    assert layout.clusters(m, eps=30).select("cluster").distinct().count() == 2


# --- chunks and parsing ---------------------------------------------------------------------------

PYTHON = '''import os

class Ä:
    """Doc."""

    def f(self, x):
        if x:
            return os.path.join("é", x)
        return self.f(1)


print(Ä().f(2))
'''
JAVA = """package a;
/** Says hello. */
public class Hello {
    public void say(String s) { if (s != null) { out.print(s); } }
}
"""


def source(spark, rows):
    d = spark.createDataFrame([(1, "m", p, t) for p, t in rows], "repo_id long, branch string, relative_path string, content string")
    return d.withColumn("blob_hash", F.sha2("content", 256))


def test_parse(spark):
    rows = [("a.py", PYTHON), ("Hello.java", JAVA), ("bad.py", "def ("), ("empty.py", ""), ("x.unknown", "hm"), ("n.py", None), ("t.sh", "greet() {\n  echo hi\n}\n"), ("w.js", "function go(a) { run(a); }\n")]
    n = parse.parse_files(source(spark, rows)).cache()
    found = {(r.relative_path, r.node_type, r.name) for r in n.collect()}
    assert {("a.py", "class_definition", "Ä"), ("a.py", "function_definition", "f"), ("a.py", "call", "os.path.join"), ("a.py", "call", "self.f"), ("Hello.java", "class_declaration", "Hello"), ("Hello.java", "method_declaration", "say"), ("Hello.java", "method_invocation", "out.print"), ("t.sh", "function_definition", "greet"), ("w.js", "function_declaration", "go"), ("w.js", "call_expression", "run")} <= found
    assert not any(p in ("bad.py", "empty.py", "x.unknown", "n.py") for p, _, _ in found)
    f = next(r for r in n.collect() if r.name == "f")
    assert PYTHON[f.start_char : f.end_char].startswith("def f(") and PYTHON[f.start_char : f.end_char].endswith("self.f(1)") and f.complexity == 2
    c = next(r for r in n.collect() if r.name == "Ä")
    assert c.docstring == '"""Doc."""' and f.parent_id == c.node_id
    assert next(r for r in n.collect() if r.name == "Hello").docstring == "/** Says hello. */"
    edges = graph.call_edges(parse.calls_of(n), n)
    assert (f.node_id, f.node_id) in {(r.caller, r.callee) for r in edges.collect()}


SCRIPT = """class A { constructor(a, b = f(1)) { super(a); } async m(a) { if (a) { return h(a); } } static get p() { return 1; } *gen() { yield z(); } }
function foo(x) { bar(x); }
const f = (x) => { return foo(x); };
export const g2 = async x => foo(x)
let h2 = function (a) { q(a); };
const n = 5, v = foo(3);
const o = { run(a) { go(a); }, stop: function () { halt(); } };
foo(function (e) { w(e); });
if (foo(x)) { baz(new Thing(1)); }
"""
TYPED = """export abstract class A<T> {
  private x: number = init();
  m(a: number): number { return k(a); }
  k(b) { return b }
  abstract q(a: string): void;
  async load(id: string): Promise<Array<T>> { await fetch(id); }
}
interface I { size(): number; }
export function make<T>(a: T): T { return wrap<T>(a); }
export const f = <T>(x: T): T => { return make(x); };
const t: (x: number) => void = (x) => log(x);
const y = cond ? make(x) : { a: 1 };
"""
JAVAS = """public class A {
  A(int x) { this.x = x; }
  public A() { this(1); }
  @Override
  public List<String> say(final Map<String, Integer> a) throws IOException, E { out.print(x); return foo(a); }
  abstract int size();
  void run() { new Thread(bar()) { public void go() { baz(); } }; if (size()) { x(); } else y(); }
  static <T> T id(T t) { return t; }
  int[] arr(int n) { for (int i = 0; i < n(); i++) { f(i); } return null; }
}
"""


def test_declarations_with_braces_are_not_calls():
    found = lambda text, lang: [(n[0], n[1]) for n in parse.parse_braces(text, lang)]
    split = lambda text, lang, call: (sorted(n for n in found(text, lang) if n[0] != call), sorted(n for k, n in found(text, lang) if k == call))
    declared, called = split(SCRIPT, "javascript", "call_expression")
    assert declared == [("class_declaration", "A"), ("function_declaration", "foo"), ("lexical_declaration", "f"), ("lexical_declaration", "g2"), ("lexical_declaration", "h2"), *(("method_definition", x) for x in ("constructor", "gen", "m", "p", "run"))]
    assert called == ["bar", "baz", "f", "foo", "foo", "foo", "foo", "foo", "go", "h", "halt", "q", "w", "z"]
    declared, called = split(TYPED, "typescript", "call_expression")
    assert declared == [("class_declaration", "A"), ("function_declaration", "make"), ("interface_declaration", "I"), ("lexical_declaration", "f"), ("lexical_declaration", "t"), *(("method_definition", x) for x in ("k", "load", "m"))]
    assert called == ["fetch", "init", "k", "log", "make", "make", "wrap"]
    declared, called = split(JAVAS, "java", "method_invocation")
    assert declared == [("class_declaration", "A"), ("constructor_declaration", "A"), ("constructor_declaration", "A"), *(("method_declaration", x) for x in ("arr", "go", "id", "run", "say", "size"))]
    assert called == ["bar", "baz", "f", "foo", "n", "out.print", "size", "x", "y"]


def test_methods_of_scripts_resolve_and_are_not_dead(spark):
    n = parse.parse_files(source(spark, [("a.js", "class A { m(a) { return k(a); } k(b) { return b; } }\nconst go = (x) => { a.m(x); };\n")])).cache()
    edges = graph.call_edges(parse.calls_of(n), n)
    name = {r.node_id: r.name for r in n.collect()}
    assert {(name[r.caller], name[r.callee]) for r in edges.collect()} == {("m", "k"), ("go", "m")}
    assert {r.name for r in graph.dead_code(n, edges).collect()} == {"A", "go"}


def test_braces_in_long_files_take_linear_time():
    import time

    text = "/** d */\nfunction f(x) { g(x, h(x)); }\nconst a = (x) => { f(x); };\n" * 3000
    start = time.time()
    assert len(parse.parse_braces(text, "javascript")) == 15_000 and time.time() - start < 10


def test_every_line_is_in_a_chunk(spark):
    long = "def g():\n" + "".join(f"    x{i} = {i} + 1\n" for i in range(400))
    files = source(spark, [("a.py", PYTHON), ("long.py", long), ("t.md", "# T\n\ntext here\n"), ("bad.py", "def (\n")]).cache()
    n = parse.parse_files(files).cache()
    rows = chunking.chunks(n, files, 200, 20).collect()
    texts = {"a.py": PYTHON, "long.py": long, "t.md": "# T\n\ntext here\n", "bad.py": "def (\n"}
    for path, text in texts.items():
        covered = set()
        for r in rows:
            if r.relative_path == path:
                assert 0 <= r.start_char <= r.end_char <= len(text)
                covered |= set(range(r.start_line, r.end_line + 1))
        for i, line in enumerate(text.split("\n"), 1):
            assert not line.strip() or i in covered, (path, i)
    parts = sorted((r for r in rows if r.relative_path == "long.py"), key=lambda r: r.start_char)
    assert len(parts) > 5 and all(r.token_count <= 200 for r in parts) and all(b.start_char < a.end_char for a, b in zip(parts, parts[1:], strict=False))
    assert [r.chunk_id for r in parts if r.parent_chunk_id is None] == [parts[0].chunk_id]
    assert len({r.chunk_id for r in rows}) == len(rows)


# --- store, sources, edits ------------------------------------------------------------------------


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.create("files", "repo_id long, branch string, p string")
    assert s.read("files", "p string, repo_id long, branch string").count() == 0
    rows = spark.createDataFrame([(1, "m", "a"), (1, "x", "b"), (2, "m", "c")], "repo_id long, branch string, p string")
    s.replace("files", rows)
    s.replace("files", spark.createDataFrame([(1, "m", "new")], rows.schema))
    assert got(s.read("files"), "repo_id", "branch", "p") == [(1, "m", "new"), (1, "x", "b"), (2, "m", "c")]
    s.drop("files", 1, "x")
    assert got(s.read("files"), "p") == [("c",), ("new",)]


def test_upsert_and_insert(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    r = spark.createDataFrame([(2, "B", "Y"), (3, "C", "Z")], t.schema)
    assert got(store.upsert(t, r, ["k"], ["v"]), "k", "v", "w") == [(1, "a", "x"), (2, "B", "y"), (3, "C", "Z")]
    assert got(store.insert_ignore(t, r.union(r), ["k"], ["v"]), "k") == [(3,)]
    assert got(store.first_of(t.union(t), ["k"], ["v"]), "k") == [(1,), (2,)]


def test_files_and_git(spark, tmp_path):
    import subprocess

    repo = tmp_path / "r"
    (repo / "node_modules").mkdir(parents=True)
    (repo / "a.py").write_bytes(b"x = 1\n\xff")
    (repo / "node_modules" / "b.js").write_text("x")
    (repo / "c.bin").write_text("x")
    rows = file_source.file_rows(file_source.scan(spark, str(repo), 1, "m")).collect()
    assert [(r.relative_path, r.content, r.language, r.line_count) for r in rows] == [("a.py", "x = 1\n", "python", 1)]
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    run("add", "-A")
    run("commit", "-m", "one")
    (repo / "a.py").write_text("y")
    (repo / "new.py").write_text("z")
    assert got(git.tree(spark, str(repo)), "relative_path") == [("a.py",), ("c.bin",), ("node_modules/b.js",)]
    assert {r.kind: r.paths for r in git.status(spark, str(repo)).collect()} == {"modified": ["a.py"], "untracked": ["new.py"]}
    assert got(git.branches(spark, str(repo)), "branch") == [("main",)]
    for odd in ("a b.py", "é.py", 'q"t.py', "x -> y.py"):
        (repo / odd).write_text("z")
    run("add", "é.py")
    run("mv", "c.bin", "moved -> c.bin")
    assert {r.kind: r.paths for r in git.status(spark, str(repo)).collect()} == {"modified": ["a.py"], "new": ["é.py"], "renamed": ["moved -> c.bin"], "untracked": ["a b.py", "new.py", 'q"t.py', "x -> y.py"]}
    assert "+y" in git.diff(str(repo), "a.py") and git.current_branch(str(repo)) == "main"


def test_status_lines(spark):
    lines = spark.createDataFrame([(x,) for x in (" M a", "M  b", "MM c", "A  d", "AM e", " D f", "D  g", "?? h", "R  i -> j", "UU k")], "line string")
    assert got(git.parse_status(lines), "kind", "path") == [("deleted", "g"), ("modified", "a"), ("modified", "b"), ("modified", "c"), ("modified", "f"), ("new", "d"), ("new", "e"), ("renamed", "j"), ("untracked", "h")]


def test_edits(tmp_path):
    p = tmp_path / "a.py"
    assert editing.create_file(str(p), "x = 1\ny = 2\n").result == "success"
    assert editing.create_file(str(p), "").result == "failure"
    e = editing.replace_lines(str(p), 2, 2, "y = 3", str(tmp_path / "bak"))
    assert e.result == "success" and "+y = 3" in e.diff and p.read_text() == "x = 1\ny = 3\n" and len(list((tmp_path / "bak").iterdir())) == 1
    assert editing.replace_lines(str(p), 2, 2, "y = (").result == "syntax_error" and p.read_text() == "x = 1\ny = 3\n"
    assert editing.find_and_replace(str(p), r"x = (\d)", r"x = \g<1>0").result == "success" and p.read_text().startswith("x = 10")
    assert editing.replace_lines(str(p), 5, 9, "").result == "failure"


def test_fixed_batches(spark):
    d = spark.range(1050)
    assert got(file_source.fixed_batches(d, ["id"], 100).groupBy("batch").count(), "batch", "count") == [(i, 100) for i in range(10)] + [(10, 50)]


def test_fixed_batches_keep_whole_rows(spark):
    """Rows with further columns, over many ranges that adaptive execution merges."""
    d = spark.range(60_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 512).alias("text"), (F.col("id") % 7).alias("k")).repartition(16)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300k")
    try:
        found = file_source.fixed_batches(d, ["id"], 700)
        assert found.count() == 60_000 and found.where(F.col("batch") != F.floor(F.col("id") / 700)).isEmpty()
        assert found.columns == [*d.columns, "batch"] and found.where(F.sha2(F.col("id").cast("string"), 512) != F.col("text")).isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_facade(spark, tmp_path):
    from codelode.facade import Analysis

    repo = tmp_path / "src"
    repo.mkdir()
    (repo / "a.py").write_text(PYTHON)
    (repo / "b.py").write_text("def unused():\n    return 1\n")
    a = Analysis(spark, str(tmp_path / "store"))
    assert a.analyze_branch(str(repo), 1, "m")["files_parsed"] == 2
    assert a.analyze_branch(str(repo), 1, "m")["files_parsed"] == 0
    r = a.get_repository_statistics(1, "m").first()
    assert r.file_count == 2 and r.language_breakdown == {"python": 2}
    assert "unused" in {x["name"] for x in a.find_dead_code(1, "m").collect()}
    assert got(a.find_symbol_definition(1, "m", "unused"), "relative_path") == [("b.py",)]
    assert got(a.search_files_for_text(1, "m", ["DOC."]), "relative_path") == [("a.py",)]
    assert a.get_file_content(1, "m", "b.py").first()["content"].startswith("def unused")
    assert a.search_code(1, "m", "def unused return", 1).first()["relative_path"] == "b.py"
    assert got(a.list_files_in_repository(1, "m"), "entry") == [("a.py",), ("b.py",)]
    assert a.get_repository_statistics(2, "m").count() == 0


def test_a_removed_call_leaves_no_edge(spark, tmp_path):
    from codelode.facade import Analysis

    folder = tmp_path / "code"
    folder.mkdir()
    (folder / "a.py").write_text("def f():\n    return 1\n\n\ndef g():\n    return f()\n")
    a = Analysis(spark, f"{tmp_path}/store")
    mine = spark.range(3).cache()
    a.analyze_branch(str(folder), 1, "main")
    assert {r.name for r in a.find_dead_code(1, "main").collect()} == {"g"}
    (folder / "a.py").write_text("def f():\n    return 1\n\n\ndef g():\n    return 2\n")
    a.analyze_branch(str(folder), 1, "main")
    assert {r.name for r in a.find_dead_code(1, "main").collect()} == {"f", "g"}
    assert a.find_symbol_references(1, "main", "f").count() == 0
    assert mine.is_cached  # others' caches stay
    (folder / "a.py").unlink()
    a.analyze_branch(str(folder), 1, "main")
    assert a.of("files", 1, "main").count() == a.of("nodes", 1, "main").count() == a.of("chunks", 1, "main").count() == 0


def test_an_edited_file_is_all_that_is_made_anew(spark, tmp_path):
    """Edges equal a rebuild; only chunks of new content are embedded, not those of unchanged, moved or copied files."""
    from codelode.facade import Analysis

    folder, log = tmp_path / "code", tmp_path / "log"
    folder.mkdir()
    log.mkdir()

    def embedder(texts, log=str(log)):
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write("\0".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    def embedded():
        out = [x for f in log.iterdir() for x in f.read_text().split("\0")]
        for f in log.iterdir():
            f.unlink()
        return sorted(out)

    text = {"a.py": "def f():\n    return g()\n", "b.py": "def g():\n    return h()\n", "c.py": "def k():\n    return f() + g()\n", "d.js": "class A { m(x) { return g(x); } }\n"}
    for name, own in text.items():
        (folder / name).write_text(own)
    a, fresh = Analysis(spark, f"{tmp_path}/store", embedder), 0

    def check():
        nonlocal fresh
        fresh += 1
        whole = Analysis(spark, f"{tmp_path}/whole{fresh}")
        whole.analyze_branch(str(folder), 1, "m")
        edges = lambda x: got(x.of("edges", 1, "m"), "caller", "callee")
        assert edges(a) == edges(whole)
        nodes = [c for c in whole.of("nodes", 1, "m").columns]
        assert got(a.of("nodes", 1, "m").na.fill(""), *nodes) == got(whole.of("nodes", 1, "m").na.fill(""), *nodes)
        own = ["chunk_id", "relative_path", "blob_hash", "start_line", "end_line", "token_count"]
        assert got(a.of("chunks", 1, "m"), *own) == got(whole.of("chunks", 1, "m"), *own)
        assert a.of("chunks", 1, "m").where("embedding is null").isEmpty()
        assert got(a.of("files", 1, "m"), "relative_path", "chunk_count") == got(whole.of("files", 1, "m"), "relative_path", "chunk_count")

    a.analyze_branch(str(folder), 1, "m")
    assert len(embedded()) == 5
    (folder / "b.py").write_text("def g():\n    return 1\n\n\ndef h():\n    return f()\n")
    assert a.analyze_branch(str(folder), 1, "m") == {"files_parsed": 1, "chunks_embedded": 2}
    assert embedded() == ["def g():\n    return 1", "def h():\n    return f()"]
    check()
    (folder / "a.py").rename(folder / "moved.py")
    (folder / "copy.py").write_text(text["c.py"])
    (folder / "d.js").unlink()
    assert a.analyze_branch(str(folder), 1, "m") == {"files_parsed": 2, "chunks_embedded": 0}
    check()
    assert a.analyze_branch(str(folder), 1, "m") == {"files_parsed": 0, "chunks_embedded": 0}
    check()
    assert embedded() == [] and not list((tmp_path / "store" / "_staged").iterdir())


def test_factored_graph_equals_its_edges(spark):
    rng = random.Random(2)
    rows = [("main", f"f{i % 5}", f"n{i}", rng.choice(["function_definition", "class_definition", "module"]), rng.choice("abcde") if i % 9 else None) for i in range(60)] + [("x", "f", "n0", "function_definition", "a")]
    n = nodes(spark, rows)
    calls = spark.createDataFrame([(1, rng.choice(["main", "main", "x"]), f"n{rng.randrange(60)}", rng.choice(["p.", ""]) + rng.choice("abcdez")) for _ in range(70)], S.CALLS)
    edges, g = graph.call_edges(calls, n).cache(), factored.call_graph(calls, n)
    assert got(g.edges(), "branch", "caller", "callee") == got(edges, "branch", "caller", "callee")
    assert got(g.edge_count(), "branch", "edges") == got(edges.groupBy("branch").count(), "branch", "count")
    assert got(g.incoming(n), "branch", "node_id", "calls_in") == got(graph.incoming(n, edges), "branch", "node_id", "calls_in")
    assert got(g.outgoing(), "branch", "node_id", "calls_out") == got(edges.groupBy("branch", "caller").count(), "branch", "caller", "count")
    assert got(g.central_nodes(n), "node_id", "calls_in") == got(graph.central_nodes(n, edges), "node_id", "calls_in")
    assert got(g.dead_code(n), "branch", "node_id") == got(graph.dead_code(n, edges), "branch", "node_id")
    assert got(g.references(n, "a"), "branch", "node_id") == got(graph.symbol_references(n, edges, "a"), "branch", "node_id")
    assert got(g.file_dependencies(n), "branch", "from_file", "to_file", "calls") == got(graph.file_dependencies(n, edges), "branch", "from_file", "to_file", "calls")
    roots = n.where("node_id in ('n1', 'n7', 'n30')")
    for back in (False, True):
        for depth in (1, 3, 60):
            assert got(g.hierarchy(roots, depth, back), "branch", "root", "node_id", "level") == got(graph.call_hierarchy(edges, roots, depth, back), "branch", "root", "node_id", "level")
    assert g.hierarchy(roots, None).count() == g.hierarchy(roots, 60).count()


def test_a_name_of_many_callers_and_definitions(spark):
    """Ten thousand definitions and a hundred thousand callers of one name: a billion edges, never made."""
    n = spark.range(10_000).select(F.lit(1).cast("long").alias("repo_id"), F.lit("m").alias("branch"), F.concat(F.lit("d"), "id").alias("node_id"), F.lit("function_definition").alias("node_type"), F.lit("get").alias("name"))
    calls = spark.range(100_000).select(F.lit(1).cast("long").alias("repo_id"), F.lit("m").alias("branch"), F.concat(F.lit("c"), "id").alias("caller"), F.lit("x.get").alias("called_name"))
    g = factored.call_graph(calls, n)
    assert g.edge_count().first().edges == 1_000_000_000 and g.dead_code(n).isEmpty()
    assert got(g.central_nodes(n, 2), "node_id", "calls_in") == [("d0", 100_000), ("d1", 100_000)]
    root = spark.createDataFrame([(1, "m", "c5")], "repo_id long, branch string, node_id string")
    assert g.hierarchy(root, None).count() == 10_001


def test_duplicates_have_paths_and_content(spark, tmp_path):
    from codelode.facade import Analysis

    folder = tmp_path / "code"
    folder.mkdir()
    body = "def total(rows):\n    out = 0\n    for row in rows:\n        out += row\n    return out\n"
    (folder / "a.py").write_text(body)
    (folder / "b.py").write_text("# other\n" + body)
    a = Analysis(spark, f"{tmp_path}/store")
    a.analyze_branch(str(folder), 1, "main")
    got = [r for r in a.find_duplicate_code(1, "main").collect() if r.content_a.startswith("def total")]
    assert got and {got[0].path_a, got[0].path_b} == {"a.py", "b.py"} and got[0].content_b.startswith("def total") and sorted((got[0].start_line_a, got[0].start_line_b)) == [1, 2]


def test_repositories_and_tasks(spark, tmp_path):
    from codelode.facade import Analysis

    a = Analysis(spark, f"{tmp_path}/store")
    assert a.list_repositories().count() == a.get_tasks().count() == 0
    one, two = a.add_repository("/src/zebra"), a.add_repository("/src/ant/")
    assert a.add_repository("/src/zebra") == one != two
    assert [r.name for r in a.list_repositories().collect()] == ["ant", "zebra"]
    top = a.start_task(one, "analyse")
    child = a.start_task(one, "parse", parent_id=top)
    a.update_task(child, "half", 50.0, {"files": "3"})
    a.complete_task(child)
    a.complete_task(top, "broke")
    state = {r.task_id: r for r in a.get_tasks().collect()}
    assert (state[child].status, state[child].progress, state[child].details["files"], state[child].log_history) == ("completed", 100.0, "3", ["half"])
    assert state[top].status == "failed" and state[top].message == "broke"
    page = a.get_task_history(one).collect()
    assert [r.task_id for r in page] == [top] and [c.child_id for c in page[0].children] == [child] and a.get_latest_task(one).first().task_id == top
    assert a.get_database_size().endswith("KB") or a.get_database_size().endswith(" B")


def test_short_periods_and_no_limits(spark):
    rows = spark.sql("SELECT 'k' AS api_key, 'm' AS model_name, timestamp_millis(1700000000000 + x) AS ts FROM VALUES (0), (200), (700), (1300) AS v(x)")
    hit = ratelimit.violations(rows, spark.createDataFrame([("m", 1, 0.5)], "model_name string, max_requests int, period_seconds double"))
    assert [r.in_window for r in hit.collect()] == [2]
    assert ratelimit.violations(rows, spark.createDataFrame([], "model_name string, max_requests int, period_seconds double")).count() == 0


def test_replay_keeps_all_limits(spark):
    import random

    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), 1_700_000_000 + rng.random() * 60) for i in range(200)]
    d = spark.createDataFrame(rows, "request_id long, model_name string, t double").selectExpr("request_id", "model_name", "timestamp_micros(cast(t * 1000000 as bigint)) AS ts")
    got = ratelimit.replay(d, spark.createDataFrame([("a", 3, 5.0), ("a", 10, 40.0)], "model_name string, max_requests int, period_seconds double"), ["k1", "k2"]).collect()
    assert len(got) == 200 and {r.api_key for r in got if r.model_name == "b"} == {"k1"}
    for key in ("k1", "k2"):
        at = sorted(r.admitted_at for r in got if r.model_name == "a" and r.api_key == key)
        assert at and all(sum(x - p < y <= x for y in at) <= n for x in at for n, p in ((3, 5.0), (10, 40.0)))


def test_deep_trees_and_cycles(spark):
    rows = [(1, "main", f"n{i}", f"n{i - 1}" if i else None, str(i)) for i in range(30)] + [(1, "main", "x", "y", "x"), (1, "main", "y", "x", "y")]
    got = {r.node_id: r.level for r in graph.tree_paths(spark.createDataFrame(rows, "repo_id long, branch string, node_id string, parent_id string, name string")).collect()}
    assert got == {f"n{i}": i for i in range(30)}


def test_another_tokenizer_cuts_chunks(spark):
    files = spark.createDataFrame([(1, "b", "a.txt", "one two\nthree four five\nsix", "h")], "repo_id long, branch string, relative_path string, content string, blob_hash string")
    nodes = spark.createDataFrame([], "repo_id long, branch string, relative_path string, node_id string, node_type string, name string, docstring string, complexity int, start_char int, end_char int, start_line int, end_line int")
    got = chunking.chunks(nodes, files, 10, 2, token=r"\S").orderBy("start_char").collect()
    assert [r.token_count for r in got] == [10, 10, 6] and [(r.start_line, r.end_line) for r in got] == [(1, 2), (2, 2), (2, 3)]


def test_parent_chunks_of_deep_trees_and_cycles(spark):
    """A chain of 10,000 whose owners are far apart, an orphan, and a cycle with and one without an owner."""
    rows = [(1, "m", f"n{i}", f"n{i - 1}" if i else None) for i in range(10_000)] + [(1, "m", "o", "nowhere"), (1, "m", "x", "y"), (1, "m", "y", "x"), (1, "m", "p", "q"), (1, "m", "q", "p"), (1, "m", "z", "x"), (1, "b", "n5", "n4")]
    owners = ["n0", "n17", "n9000", "p"]
    chunks = spark.createDataFrame([(1, "m", x, f"c{x}") for x in owners], "repo_id long, branch string, node_id string, chunk_id string")
    got = {(r.branch, r.node_id): r.parent_chunk_id for r in chunking.parent_chunks(spark.createDataFrame(rows, "repo_id long, branch string, node_id string, parent_id string"), chunks).collect()}
    want = lambda i: None if i == 0 else "cn0" if i <= 17 else "cn17" if i <= 9000 else "cn9000"
    assert all(got["m", f"n{i}"] == want(i) for i in range(10_000)) and len(got) == len(rows)
    assert got["m", "o"] is got["m", "x"] is got["m", "z"] is got["b", "n5"] is None and got["m", "q"] == got["m", "p"] == "cp"


def test_spans_and_gaps(spark):
    rng = random.Random(4)
    ranges = [(k, a, a + rng.randrange(-1, 6)) for k in range(8) for a in (rng.randrange(-3, 45) for _ in range(rng.randrange(9)))] + [(3, None, 4), (9, 1, 5)]
    r = spark.createDataFrame(ranges, "k int, first_line long, last_line long")
    whole = spark.createDataFrame([(k, 1, 40) for k in range(9)], "k int, first_line long, last_line long")
    covered = lambda k: {x for c, a, b in ranges if c == k and a is not None for x in range(a, b + 1)}
    spelt = lambda rows, k: sorted(x for c, a, b in rows if c == k for x in range(a, b + 1))
    spans, gaps = got(chunking.spans(r, ["k"]), "k", "first_line", "last_line"), got(chunking.gaps(whole, r, ["k"]), "k", "first_line", "last_line")
    for k in range(10):
        assert spelt(spans, k) == sorted(covered(k)) and spelt(gaps, k) == [x for x in range(1, 41) if k < 9 and x not in covered(k)]
    for rows in (spans, gaps):
        assert all(x[0] != y[0] or y[1] > x[2] + 1 for x, y in zip(rows, rows[1:], strict=False))


def brute_clusters(points, eps, least):
    """Labels in the order of blocks: clusters by their first core block, then lone blocks."""
    n = len(points)
    near = [[j for j in range(n) if (points[i][0] - points[j][0]) ** 2 + (points[i][1] - points[j][1]) ** 2 <= eps**2] for i in range(n)]
    core, out, c = [len(x) >= least for x in near], [None] * n, 0
    for i in range(n):
        if core[i] and out[i] is None:
            todo = [i]
            while todo:
                j = todo.pop()
                if out[j] is None:
                    out[j] = c
                    todo += [k for k in near[j] if core[k] and out[k] is None] if core[j] else []
            c += 1
    first = [min((out[k] for k in near[i] if core[k]), default=None) if not core[i] else out[i] for i in range(n)]
    for i in range(n):
        if first[i] is None:
            first[i], c = c, c + 1
    return first


@pytest.mark.parametrize(("least", "eps"), [(1, 5.0), (2, 6.0), (4, 9.0), (7, 12.0)])
def test_clusters_equal_brute_force(spark, least, eps):
    rng, rows = random.Random(least), []
    for page in (1, 2, None):
        spots = [(rng.uniform(0, 120), rng.uniform(0, 90)) for _ in range(70)]
        spots += [(x + rng.choice([0, 3, 6, 9, 12]), y) for x, y in spots[:30]] + spots[:6]
        rows += [(page, i, x - 1, y - 1, x + 1, y + 1) for i, (x, y) in enumerate(spots)]
    b = spark.createDataFrame(rows, "page int, block_id long, x0 double, y0 double, x1 double, y1 double")
    found = {(r.page, r.block_id): r.cluster for r in layout.clusters(b, eps=eps, least=least).collect()}
    for page in (1, 2, None):
        own = [r for r in rows if r[0] == page]
        assert [found[page, r[1]] for r in own] == brute_clusters([((r[2] + r[4]) / 2, (r[3] + r[5]) / 2) for r in own], eps, least)


def test_a_page_of_many_blocks(spark):
    """20,000 blocks on one page, in rows of 100 that each are one cluster, and 2,000 copies of one block."""
    n = 20_000
    b = spark.range(n).select(F.lit(1).alias("page"), F.col("id").alias("block_id"), F.when(F.col("id") % 10 == 0, 5.0).otherwise((F.col("id") % 100) * 4.0).alias("x0"), F.when(F.col("id") % 10 == 0, -500.0).otherwise(F.floor(F.col("id") / 100) * 30.0).alias("y0"))
    b = b.withColumn("x1", F.col("x0") + 2).withColumn("y1", F.col("y0") + 2)
    assert layout.clusters(b, eps=8.5, least=2).agg(F.count("*"), F.count_distinct("cluster")).first() == (n, 201)


def test_valleys_and_bands(spark):
    rows = [(1, 0, 0.0, 10.0), (1, 1, 2.0, 12.0), (1, 2, 20.0, 30.0), (1, 3, 11.0, 21.0), (1, 4, 40.0, 50.0), (1, 5, 35.0, 35.0), (1, 6, None, 4.0), (2, 0, 1.0, 2.0), (2, 1, 2.0, 3.0)]
    b = spark.createDataFrame(rows, "page int, block_id long, y0 double, y1 double")
    assert got(layout.valleys(b), "page", "band_no", "first", "last") == [(1, 0, 0.0, 10.5), (1, 1, 10.5, 16.0), (1, 2, 16.0, 35.0), (1, 3, 35.0, 50.0), (2, 0, 1.0, 3.0)]
    assert got(layout.valleys(b, most=0), "page", "band_no", "first", "last") == [(1, 0, 0.0, 35.0), (1, 1, 35.0, 50.0), (2, 0, 1.0, 3.0)]
    assert {(r.page, r.block_id): r.band_no for r in layout.banded(b).collect()} == {(1, 0): 0, (1, 1): 0, (1, 2): 2, (1, 3): 1, (1, 4): 3, (1, 5): None, (1, 6): None, (2, 0): 0, (2, 1): 0}


def dealt_after(df, join):
    """Shuffles of the plan as it was run that have a join, named by the begin of its key, below them."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
    deep = [re.search(r"[A-Za-z*]|$", x).start() for x in lines]
    out = []
    for i, x in enumerate(lines):
        if " Exchange " in x:
            end = next((j for j in range(i + 1, len(lines)) if deep[j] <= deep[i]), len(lines))
            out += [x] if any(re.search(rf"Join \[[^\]]*{join}", y) for y in lines[i:end]) else []
    return out


def test_edges_are_not_dealt_to_be_made_distinct(spark, sf):
    calls = spark.createDataFrame([(1, "m", f"c{i % 40}", "x.f") for i in range(80)] + [(1, "m", "c0", "g"), (1, "m", "c0", "h")], "repo_id long, branch string, caller string, called_name string")
    single = spark.createDataFrame([(1, "m", f"d{i}", "function_definition", "f") for i in range(30)], "repo_id long, branch string, node_id string, node_type string, name string")
    edges = graph.call_edges(calls, single)
    assert not dealt_after(edges, "name#") and edges.count() == edges.distinct().count() == 40 * 30
    # a node of two names, both of which a caller calls, is one edge
    both = single.unionByName(spark.createDataFrame([(1, "m", "e", "function_definition", "g"), (1, "m", "e", "function_definition", "h")], single.schema))
    edges = graph.call_edges(calls, both)
    assert edges.count() == edges.distinct().count() == 40 * 30 + 1
    assert not dealt_after(catalogue.QUERIES["edges_after_change"](spark, sf), "name#")


def test_edges_are_made_by_many_tasks_and_merged(spark, sf):
    """Tasks aren't merged by what they read, which is far less than the edges that they make, and no side is held as a hash table."""
    calls = spark.createDataFrame([(b, x, f"c{i % 40}", f"x.f{i % 7}") for b in (1, 2) for x in "mn" for i in range(400)], "repo_id long, branch string, caller string, called_name string")
    some = spark.createDataFrame([(b, x, f"d{i}", "function_definition", f"f{i % 9}") for b in (1, 2) for x in "mn" for i in range(90)], "repo_id long, branch string, node_id string, node_type string, name string")
    want = {(b, x, f"c{i % 40}", f"d{j}") for b in (1, 2) for x in "mn" for i in range(400) for j in range(90) if i % 7 == j % 9}
    assert got(graph.call_edges(calls, some), "repo_id", "branch", "caller", "callee") == sorted(want)
    tasks = graph.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    p = catalogue.QUERIES["call_edges"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [name#" in p and p.count(f", {tasks}), REPARTITION_BY_NUM") >= 2
    assert catalogue.QUERIES["call_edges"](spark, sf).rdd.getNumPartitions() >= tasks


def test_edges_after_a_change_are_made_by_many_tasks(spark, sf):
    """Edges that stay, those of new calls and those of new definitions: each product is dealt by name to all of its tasks."""
    edges = catalogue.QUERIES["edges_after_change"](spark, sf)
    assert edges.rdd.getNumPartitions() >= 3 * graph.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert edges._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("SortMergeJoin [name#") >= 3


def test_parents_and_owners_come_with_the_parse(spark, sf):
    files = source(spark, [("a.py", PYTHON), ("Hello.java", JAVA), ("s.js", SCRIPT), ("t.ts", TYPED), ("A.java", JAVAS), ("bad.py", "def ("), ("n.py", None)])
    n = parse.parse_files(files).cache()
    names = {r.node_id: r.name for r in n.collect()}
    assert sorted((r.node_id, r.parent or "") for r in parse.parse_files(files, parents=True).collect()) == sorted((r.node_id, names.get(r.parent_id) or "") for r in n.collect())
    assert sorted((r.caller, r.called_name, r.owner) for r in parse.parse_calls(files).collect()) == sorted((r.caller, r.called_name, names[r.caller]) for r in parse.calls_of(n).collect())
    # no side of a join is broadcast because its sources are small files, and a table of one split is parsed by all cores
    for name in ("extracted_nodes", "extracted_brace_nodes", "extracted_calls"):
        p = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in p and p.count("MapInPandas") == 1 and "REPARTITION_BY_NUM" in p


def test_throughput_of_marks_of_one_time(spark):
    rows = [(1, "a", 10, 1), (2, "a", 10, 2), (3, "a", 10, 2), (4, "a", 12, 6)]
    marks = spark.createDataFrame(rows, "event_id int, k string, t long, total long").selectExpr("event_id", "k", "timestamp_seconds(t) AS ts", "total")
    got = {r.event_id: (r.interval_rate, r.mean_rate) for r in stats.throughput(marks, ["k"]).collect()}
    assert got[1] == (None, None) and got[2] == (float("inf"), None) or got[3] == (float("inf"), None)
    assert sorted(str(got[i][0]) for i in (2, 3)) == ["inf", "nan"] and got[4] == (2.0, 2.5)


def test_replay_keeps_microseconds_of_far_times(spark):
    """A backlog of a million requests ends after 2^32 seconds, where those in a double, turned back, miss some microseconds."""
    us = [4_294_969_000_000_001 + 7 * i for i in range(200)]
    d = spark.createDataFrame([(i, "a", t) for i, t in enumerate(us)], "request_id long, model_name string, t long").selectExpr("request_id", "model_name", "timestamp_micros(t) AS ts")
    got = ratelimit.replay(d, spark.createDataFrame([("a", 1, 3600.000001)], "model_name string, max_requests int, period_seconds double"), ["k"])
    rotation = ratelimit.Rotation([(1, 3600.000001)], ["k"])
    want = [rotation.admit(t)[1] for t in us]
    rows = got.withColumn("turned", F.round(F.col("admitted_at") * 1_000_000).cast("long")).orderBy("request_id").collect()
    assert [r.admitted_us for r in rows] == want and any(r.turned != x for r, x in zip(rows, want, strict=True))


def test_spans_and_gaps_equal_plain_sets_and_sort_once(spark):
    rng = random.Random(5)
    rows = [(k, a, a + rng.randrange(-1, 5)) for k in range(30) for a in (rng.randrange(60) for _ in range(rng.randrange(12)))]
    r = spark.createDataFrame(rows + rows[:20] + [(1, None, 5), (2, 3, None)], "k long, first_line long, last_line long")
    runs = lambda some: [(x[0], x[-1]) for x in np.split(np.array(sorted(some)), np.flatnonzero(np.diff(sorted(some)) > 1) + 1) if len(x)]
    lines = {k: {i for x, a, b in rows if x == k for i in range(a, b + 1)} for k in range(31)}
    assert got(chunking.spans(r, ["k"]), "k", "first_line", "last_line") == sorted((k, int(a), int(b)) for k, v in lines.items() for a, b in runs(v))
    whole = spark.createDataFrame([(k, 10, 40) for k in range(31)], "k long, first_line long, last_line long")
    assert got(chunking.gaps(whole, r, ["k"]), "k", "first_line", "last_line") == sorted((k, int(a), int(b)) for k, v in lines.items() for a, b in runs(set(range(10, 41)) - v))
    # stretches are found by the sort alone: no table of groups is held by a task
    assert "Aggregate" not in chunking.spans(r, ["k"])._jdf.queryExecution().executedPlan().toString()


def test_child_totals_are_those_of_the_lists(spark, sf):
    t = Tables(spark, sf)
    parents = t.tasks().where("parent_id is null")
    lists = tasks.with_children(t.tasks(), parents).select("task_id", F.coalesce(F.size("children"), F.lit(0)).cast("long").alias("n_children"), F.col("children")[0]["started_at"].alias("first_child"))
    assert {tuple(r) for r in lists.collect()} == {tuple(r) for r in tasks.with_child_totals(t.child_tasks(), parents).select("task_id", "n_children", "first_child").collect()}
    assert "collect_list" not in catalogue.QUERIES["task_history"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_task_history_lists_children(spark, sf):
    rows = [(1, None, "r", "running", 5), (2, None, "r", "failed", 6), (3, 1, "b", "x", 9), (4, 1, "a", "x", 7), (4, 1, "a", "x", 7), (5, 1, "a", "x", 7), (6, 1, None, None, None), (7, 99, "lost", "x", 1)]
    t = spark.createDataFrame(rows, "task_id long, parent_id long, name string, status string, started_at long")
    parents = t.where("parent_id is null").select("task_id")
    want = {r.task_id: r.children for r in tasks.with_children(t, parents).collect()}
    made = tasks.with_placed_children(t, parents)
    assert {r.task_id: r.children for r in made.collect()} == want and made.schema["children"].dataType == tasks.with_children(t, parents).schema["children"].dataType
    assert [r.child_id for r in want[1]] == [6, 4, 4, 5, 3] and want[2] is None
    # the query makes the lists and doesn't only count
    p = catalogue.QUERIES["task_history"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set(struct(_place" in p and "child_id" in p


def test_posting_lists_name_contents_by_four_bytes(spark):
    blobs = spark.createDataFrame([(f"{i:064x}", "abcd" if i % 2 else "ABC") for i in range(10)], "blob_hash string, content string")
    rows = textindex.postings(blobs.coalesce(1)).collect()
    assert {r.gram: len(r.ids) for r in rows} == {"abc": 10, "bcd": 5} and len(rows) == 2
    assert textindex.matches(textindex.postings(blobs), ["abcd"]).count() == 5


def test_an_embedder_is_given_few_texts_at_once(spark):
    def model(texts):
        return [[float(len(texts)), float(len(t)), float("nan")] for t in texts]

    d = spark.createDataFrame([(i, "x" * (i % 7) if i % 5 else None) for i in range(700)], "chunk_id long, content string").coalesce(1)
    rows = search.embed(d, model).collect()
    assert len(rows) == 700 and all(r.embedding[0] <= search.TEXTS and r.embedding[1:] == [r.chunk_id % 7 if r.chunk_id % 5 else 0, 0] for r in rows)
