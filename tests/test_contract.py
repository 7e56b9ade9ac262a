"""Rules that are easy to get wrong, on small fixtures, and properties against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import charclass as cc
from tessera.functions import formatting as fmt
from tessera.functions import mathx, numbers, temporal, text
from tessera.functions.temporal import TimeUnit
from tessera.operators import aggregate, bags, caching, diff, graph, intervals, ordering
from tessera.operators import sequence as seq
from tessera.operators.graph import Graph
from tessera.operators.ordering import By
from tessera.plans.order import global_index
from tessera.sources import generators as gen


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], f"k int, ord long, v {kind}")


BY = {"order_by": "ord", "partition_by": "k"}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_runs_are_not_a_hash_grouping(spark):
    rows = seq.run_groups(frame(spark, "aaaabbbccdaabbb"), "v", **BY).orderBy("run").collect()
    assert [(r["v"], r["n"]) for r in rows] == [("a", 4), ("b", 3), ("c", 2), ("d", 1), ("a", 2), ("b", 3)]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 9])
@pytest.mark.parametrize("size,step", [(1, 1), (2, 1), (3, 2), (2, 3), (4, 4)])
@pytest.mark.parametrize("partial", [False, True])
def test_windows(spark, n, size, step, partial):
    want, i = [], 0
    while i < n:
        items = list(range(i, min(n, i + size)))
        if len(items) < size:
            want += [items] if partial else []
            break
        want.append(items)
        i += step
    got = seq.window(frame(spark, list(range(n)), "long"), "v", size, step=step, partial=partial, **BY).orderBy("start").collect()
    assert [r["items"] for r in got] == want


def test_window_arguments(spark):
    with pytest.raises(ValueError):
        seq.window(frame(spark, [1], "long"), "v", 0, **BY)
    with pytest.raises(ValueError):
        gen.integer_range(spark, 0, 1, 0)


def test_permutations_and_combinations_of_none(spark):
    f = frame(spark, "abc")
    assert seq.permutations(f, "v", 0, **BY).count() == 0
    assert [r["items"] for r in seq.combinations(f, "v", 0, **BY).collect()] == [[]]
    assert seq.combinations(f, "v", 4, **BY).count() == 0


def test_top_k(spark):
    f = frame(spark, [3, 1, 2], "long")
    assert [r["v"] for r in ordering.largest(f, By.key("v"), 9).collect()] == [3, 2, 1]
    assert [r["v"] for r in ordering.smallest(f, By.key("v"), 2).collect()] == [1, 2]
    assert ordering.largest(f, By.key("v"), 0).collect() == []


def test_reversed_comparator_flips_nulls(spark):
    f = frame(spark, [2, None, 1], "long")
    assert [r["v"] for r in ordering.sort(f, By.key("v").nulls(True).reversed()).collect()] == [2, 1, None]


def test_explicit_order_rejects_unknown(spark):
    with pytest.raises(Exception, match="not in the explicit order"):
        one(spark, ordering.explicit_rank(F.lit("x"), ["a"]))


def test_searches(spark):
    a = F.array(*[F.lit(x) for x in (1, 3, 3, 5)])
    r = one(spark, ordering.binary_search(a, F.lit(4)).alias("m"), ordering.lower_bound(a, F.lit(3)).alias("l"), ordering.upper_bound(a, F.lit(3)).alias("u"))
    assert (r["m"], r["l"], r["u"]) == (-1, 1, 3)


def test_bag_union_adds(spark):
    a = bags.bag(frame(spark, "aab"), "v")
    assert {r["element"]: r["n"] for r in bags.bag_union(a, a).collect()} == {"a": 4, "b": 2}


def test_bimap_evicts(spark):
    pairs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "y")], "o long, k string, v string")
    assert [(r["k"], r["v"]) for r in bags.bimap(pairs, "k", "v", order_by="o").collect()] == [("a", "y")]


def test_global_index_and_prefix_sums_against_python(spark):
    rng = random.Random(3)
    values = [rng.randrange(1000) for _ in range(1000)]
    f = frame(spark, values, "long")
    got = aggregate.prefix_sum(f, "v", order_by="ord").orderBy("ord").collect()
    total = 0
    for r, v in zip(got, values):
        assert r["prefix"] == total
        total += v
        assert r["running"] == total
    assert global_index(f.limit(0), "ord").count() == 0


def test_intervals_against_python(spark):
    rng = random.Random(5)
    for spread, width in ((1000, 10), (1000, 1000), (10**6, 10)):
        spans = [(i, lo := rng.uniform(0, spread), lo + rng.uniform(0, width)) for i in range(150)]
        points = [(i, rng.uniform(0, spread)) for i in range(150)]
        s = spark.createDataFrame(spans, "id long, lo double, hi double")
        p = spark.createDataFrame(points, "p long, at double")
        got = {(r["p"], r["id"]) for r in intervals.stab_join(p, s, "at", "lo", "hi").collect()}
        assert got == {(i, k) for i, x in points for k, lo, hi in spans if lo <= x <= hi}
        o = s.select(F.col("id").alias("id2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        rows = intervals.overlap_join(s, o, ("lo", "hi"), ("lo2", "hi2")).select("id", "id2").collect()
        want = {(a, b) for a, lo, hi in spans for b, lo2, hi2 in spans if lo <= hi2 and lo2 <= hi}
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_character_classes(spark):
    got = one(spark, cc.pattern("a-z-[aeiou]").retain(F.lit("hello world")).alias("a"), cc.LETTER_OR_DIGIT.retain(F.lit("a_b-c")).alias("b"), cc.WHITESPACE.trim(F.lit("\t x ")).alias("c"), cc.is_char("😀").trim_trailing(F.lit("a😀😀")).alias("d"), (cc.in_range("a", "z") | cc.is_char("b")).retain(F.lit("xyz!")).alias("e"))
    assert tuple(got) == ("hllwrld", "a_bc", "x ", "a", "xyz")


def test_text_rules(spark):
    s = F.lit("a.b.c")
    got = one(spark, text.partition(s, "x").alias("a"), text.last_partition(s, "x").alias("b"), text.last_partition(s, ".").alias("c"), text.wrap(F.lit("aaa bb  c\nddddddd"), 5).alias("d"), text.dedent(F.lit("  x\n\n    y")).alias("e"), text.unwrap(F.lit("a\nb\n\nc")).alias("f"), text.chunked(F.lit(""), 2).alias("g"))
    assert got["a"] == ["a.b.c", "", ""] and got["b"] == ["", "", "a.b.c"] and got["c"] == ["a.b", ".", "c"]
    assert got["d"] == "aaa\nbb c\nddddd\ndd" and got["e"] == "x\n\n  y" and got["f"] == "a b\n\nc" and got["g"] == []


def test_dates(spark):
    t = F.lit("2024-12-30 10:20:30.123456").cast("timestamp_ntz")
    got = one(spark, temporal.week_year(t).alias("y"), temporal.week_number(t).alias("w"), temporal.truncate(t, TimeUnit.DECADE).alias("d"), temporal.shift_months(F.lit("2024-01-31 01:00:00").cast("timestamp_ntz"), F.lit(1)).alias("m"))
    assert (got["y"], got["w"], str(got["d"]), str(got["m"])) == (2025, 1, "2020-01-01 00:00:00", "2024-03-02 01:00:00")
    months = [str(r["at"])[:10] for r in temporal.periodical(spark, "2023-01-31", TimeUnit.MONTH, 4).orderBy("place").collect()]
    assert months == ["2023-01-31", "2023-03-03", "2023-04-03", "2023-05-03"]
    parts = one(spark, temporal.convert_to_all(F.lit(3_600_000_001), [TimeUnit.HOUR]).alias("m"))["m"]
    assert parts == {"hour": 1, "microsecond": 1}


def test_numbers(spark):
    x = numbers.fr(F.lit(6), F.lit(-8))
    got = one(spark, x.alias("x"), numbers.fr(F.lit(3), F.lit(0)).alias("i"), numbers.fr(F.lit(0), F.lit(0)).alias("n"), mathx.digits(F.lit(-120)).alias("d"), mathx.digits(F.lit(0)).alias("z"), aggregate.gcd_pair(F.lit(0), F.lit(-6)).alias("g"))
    assert tuple(got["x"]) == (-3, 4) and tuple(got["i"]) == (1, 0) and tuple(got["n"]) == (0, 0)
    assert got["d"] == [0, 2, 1] and got["z"] == [0] and got["g"] == 6
    assert [(r["a"], r["b"]) for r in numbers.farey(spark, 4).orderBy("place").collect()] == [(0, 1), (1, 4), (1, 3), (1, 2), (2, 3), (3, 4), (1, 1)]
    n = spark.createDataFrame([(561,), (2**61 - 1,), (1,), (2,)], "n long")
    assert [r[0] for r in n.select(mathx.is_prime("n")).collect()] == [False, True, False, True]
    assert math.isnan(one(spark, mathx.log(F.lit(-1.0)).alias("l"))["l"])


# -- graphs ---------------------------------------------------------------------------


def edges(spark, rows, directed=True, vertices=None):
    e = spark.createDataFrame(rows, "src long, dst long, value long")
    v = spark.createDataFrame([(x,) for x in vertices], "id long") if vertices is not None else None
    return Graph.of(e, v, directed)


def test_isolated_vertices_are_components(spark):
    g = edges(spark, [(1, 2, 1), (3, 2, 1)], vertices=[9])
    assert {r["id"]: r["component"] for r in graph.connected(g).collect()} == {1: 1, 2: 1, 3: 1, 9: 9}


def test_components_against_python(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(200), rng.randrange(200), 1) for _ in range(150)]
    label = list(range(200))
    for _ in range(200):
        for a, b, _w in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["id"]: r["component"] for r in graph.connected(edges(spark, pairs, vertices=range(200))).collect()}
    assert got == dict(enumerate(label))


def test_shortest_paths(spark):
    g = edges(spark, [(1, 2, 4), (1, 3, 1), (3, 2, 1), (2, 4, 1)])
    start = spark.createDataFrame([(1,)], "id long")
    paths = graph.shortest_paths(g, start)
    assert {r["id"]: r["cost"] for r in paths.collect()} == {1: 0.0, 3: 1.0, 2: 2.0, 4: 3.0}
    ends = spark.createDataFrame([(4,), (3,), (9,)], "id long")
    assert sorted((r["target"], r["back"], r["id"]) for r in graph.path_to(paths, ends).collect()) == [(3, 0, 3), (3, 1, 1), (4, 0, 4), (4, 1, 2), (4, 2, 3), (4, 3, 1)]
    even = edges(spark, [(1, 2, 1), (1, 3, 1), (2, 4, 1), (3, 4, 1), (4, 5, 0)])
    routes = graph.all_paths_to(even, graph.shortest_paths(even, start), spark.createDataFrame([(5,)], "id long"))
    assert sorted(r["route"] for r in routes.collect()) == [[1, 2, 4, 5], [1, 3, 4, 5]]
    with pytest.raises(ValueError, match="heuristic"):
        graph.shortest_paths(g, start, heuristic=F.lit(0.0))
    with pytest.raises(ValueError, match="negative"):
        graph.shortest_paths(edges(spark, [(1, 2, -1)]), start)
    with pytest.raises(ValueError, match="cycle"):
        graph.shortest_paths(edges(spark, [(1, 2, -1), (2, 1, -1)]), start, negative=True)


def test_flow_cut_cliques_colours(spark):
    g = edges(spark, [(0, 1, 3), (0, 2, 1), (1, 3, 3), (2, 3, 5), (3, 4, 4), (4, 5, 2), (2, 4, 2)])
    assert graph.max_flow(g, 0, 5) == 2 and graph.max_flow(g, 0, 4) == 4
    u = edges(spark, [(1, 2, 2), (2, 3, 3), (1, 3, 3), (3, 4, 1)], directed=False)
    assert [r["weight"] for r in graph.min_cut(u).collect()] == [1.0]
    assert sorted(r["members"] for r in graph.cliques(u).collect()) == [[1, 2, 3], [3, 4]]
    colour = {r["id"]: r["colour"] for r in graph.colouring(u).collect()}
    assert all(colour[a] != colour[b] for a, b in ((1, 2), (2, 3), (1, 3), (3, 4)))


def test_cycles_and_bipartite(spark):
    assert graph.has_cycle(edges(spark, [(1, 2, 1), (2, 1, 1)])) and graph.has_cycle(edges(spark, [(1, 1, 1)]))
    assert not graph.has_cycle(edges(spark, [(1, 2, 1), (1, 3, 1), (2, 3, 1)]))
    assert not graph.is_bipartite(edges(spark, [(1, 2, 1), (2, 3, 1), (3, 1, 1)]))
    assert graph.is_bipartite(edges(spark, [(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 1, 1)]))


def test_spanning_trees(spark):
    pairs = [(i, j, (i * 7 + j * 13) % 23 + 1) for i in range(9) for j in range(i) if (i + j) % 3]
    label, total = list(range(9)), 0
    for a, b, w in sorted(pairs, key=lambda p: p[2]):  # plainly, the cheapest first
        if label[a] != label[b]:
            old, new = label[a], label[b]
            label, total = [new if x == old else x for x in label], total + w
    u = edges(spark, [*pairs, (20, 21, 5)], directed=False)
    assert sum(r["value"] for r in graph.spanning_forest(u).collect()) == total + 5
    assert {(r["src"], r["dst"]) for r in graph.spanning_tree_from(u, 21).collect()} == {(20, 21)}


def test_cuts_flows_and_cliques_against_every_subset(spark):
    rng = random.Random(5)
    pairs = [(i, j, rng.randint(1, 9)) for i in range(7) for j in range(7) if i != j and rng.random() < 0.5]
    cuts = [[v for v in range(7) if m >> v & 1] for m in range(1 << 7)]
    crossing = lambda side: sum(w for a, b, w in pairs if a in side and b not in side)
    assert graph.max_flow(edges(spark, pairs), 0, 6) == min(crossing(s) for s in cuts if 0 in s and 6 not in s)
    flat = {}
    for a, b, w in pairs:
        flat[min(a, b), max(a, b)] = w
    both = [(a, b, w) for (a, b), w in flat.items()]
    cut = graph.min_cut(edges(spark, both, directed=False)).collect()[0]
    weight = lambda side: sum(w for a, b, w in both if (a in side) != (b in side))
    assert cut["weight"] == min(map(weight, cuts[1:-1])) == weight(cut["side"]) and 0 not in cut["side"]
    full = [s for s in cuts[1:] if all((a, b) in flat for a in s for b in s if a < b)]
    assert sorted(r["members"] for r in graph.cliques(edges(spark, both, directed=False)).collect()) == sorted(s for s in full if not any(set(s) < set(o) for o in full))


def test_strong_components_against_reachability(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(30), rng.randrange(30), 1) for _ in range(45)]
    reach = {v: {v} for v in range(30)}
    for _ in range(30):
        for a, b, _w in pairs:
            for r in reach.values():
                if a in r:
                    r.add(b)
    want = {v: min(o for o in reach[v] if v in reach[o]) for v in range(30)}
    got = {r["id"]: r["component"] for r in graph.strongly_connected(edges(spark, pairs, vertices=range(30))).collect()}
    assert got == want


def test_dot(spark):
    g = edges(spark, [(10, 20, 3), (20, 30, 4)])
    assert g.to_dot("x") == 'digraph x {\n  0 [label="10"];\n  1 [label="20"];\n  2 [label="30"];\n  0 -> 1 [label="3"];\n  1 -> 2 [label="4"];\n}'
    with pytest.raises(ValueError, match="write_dot"):
        g.to_dot(most=3)


def test_intervals_of_very_different_lengths(spark):
    rng = random.Random(3)
    spans = [(i, a := rng.uniform(-500, 500), a + rng.choice([0.0, 0.5, 3.0, 80.0, 2000.0])) for i in range(150)]
    left = spark.createDataFrame(spans, "i long, a double, b double")
    right = spark.createDataFrame(spans, "j long, c double, d double")
    got = sorted((r["i"], r["j"]) for r in intervals.overlap_join(left, right, ("a", "b"), ("c", "d")).collect())
    assert got == sorted((i, j) for i, a, b in spans for j, c, d in spans if a <= d and c <= b)
    points = spark.createDataFrame([(i, a) for i, a, _ in spans], "p long, x double")
    hit = sorted((r["p"], r["i"]) for r in intervals.stab_join(points, left, "x", "a", "b").collect())
    assert hit == sorted((p, i) for p, x, _ in spans for i, a, b in spans if a <= x <= b)


def test_prime_factors_of_large_numbers(spark):
    numbers = [1, 2, 97, 2**61 - 1, 4294967291 * 2147483647, 999999937 * 999999937 // 1, 2**62, 600851475143, 3 * 3 * 3037000493 * 11]
    got = {r["n"]: r["factors"] for r in mathx.prime_factors(spark.createDataFrame([(n,) for n in numbers], "n long"), "n").collect()}
    for n in numbers:
        assert math.prod(got[n]) == n and got[n] == sorted(got[n]) and all(mathx._prime(p) for p in got[n])
    assert got[2**61 - 1] == [2**61 - 1] and got[4294967291 * 2147483647] == [2147483647, 4294967291]


def test_numerals_and_properties(spark):
    assert len(fmt.NUMERALS) >= 68 and fmt.NUMERALS["thai"] == 0xE50 and fmt.NUMERALS["devanagari"] == 0x966
    got = one(spark, cc.binary_property("diacritic").count(F.lit("a^`x")).alias("d"), cc.bidi("strong").count(F.lit("aא1")).alias("s"), cc.binary_property("unified_ideograph").count(F.lit("漢a")).alias("u"))
    assert tuple(got) == (2, 2, 1)
    with pytest.raises(ValueError):
        cc.binary_property("no such thing")


def test_close_matches_against_every_pair(spark):
    from difflib import SequenceMatcher

    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abcde", k=rng.randint(0, 7))) for _ in range(60)})
    asked = words[::5] + ["", "abcabc"]
    for cutoff in (0.0, 0.3, 0.6, 1.0):
        got = {(r["query"], r["word"]) for r in diff.close_matches(spark.createDataFrame([(w,) for w in words], "w string"), spark.createDataFrame([(q,) for q in asked], "q string"), "w", "q", 1000, cutoff).collect()}
        assert got == {(q, w) for q in asked for w in words if SequenceMatcher(None, w, q).ratio() >= cutoff}


# -- differences, caches, streams ---------------------------------------------------------


def test_diff(spark):
    empty = F.array().cast("array<string>")
    got = one(spark, diff.ratio(empty, empty).alias("r"), diff.quick_ratio(empty, empty).alias("q"), diff.diff(F.lit("a\nb\nc"), F.lit("a\nx\nc"), "normal").alias("n"))
    assert got["r"] == 1.0 and got["q"] == 1.0 and got["n"] == ["2c2", "< b", "---", "> x"]


def test_caches():
    loads = []
    load = lambda k: loads.append(k) or k * 2
    lru, fifo = caching.LruCache(load, 2), caching.FifoCache(load, 2)
    for cache in (lru, fifo):
        cache.get(1), cache.get(2), cache.get(1), cache.get(3)
    assert lru.get_if_present(1) == 2 and lru.get_if_present(2) is None
    assert fifo.get_if_present(1) is None and fifo.get_if_present(2) == 4
    now = [0.0]
    timed = caching.ExpiryCache(load, update_expiry=10, access_expiry=5, clock=lambda: now[0])
    timed.get(7)
    now[0] = 9
    assert timed.get_if_present(7) == 14
    now[0] = 13.9
    assert timed.get_if_present(7) == 14
    now[0] = 100
    assert timed.reap() == 1 and timed.size() == 0


def test_stream_windows_and_buffers(spark, tmp_path):
    from tessera.streaming import stream

    rows = spark.createDataFrame([("a" if i % 2 else "b", i, i * 10) for i in range(11)], "k string, ts long, v long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = stream.run_to_end(stream.window(source(), "k", "ts", "v", 2, 2))
    assert sorted((r["k"], r["start"], tuple(r["items"])) for r in got.collect()) == [("a", 0, (10, 30)), ("a", 2, (50, 70)), ("b", 0, (0, 20)), ("b", 2, (40, 60)), ("b", 4, (80, 100))]
    got = stream.run_to_end(stream.buffer(source(), "k", "ts", "v", 3))
    assert sorted((r["k"], tuple(r["items"])) for r in got.collect()) == [("a", (10, 30, 50)), ("b", (0, 20, 40)), ("b", (60, 80, 100))]


def test_strong_components_are_whole_or_an_error(spark):
    ring = graph.ring(spark, 8)
    assert {r["component"] for r in graph.strongly_connected(ring).collect()} == {0}
    with pytest.raises(RuntimeError):
        graph.strongly_connected(ring, most=3)
    assert graph.strongly_connected(graph.empty(spark, 0)).count() == 0


def test_fixed_keeps_the_sign_of_what_rounds_to_zero(spark):
    f = lambda x, *a, **k: fmt.fixed(F.lit(x), *a, **k)
    got = one(spark, f(-0.001, 2).alias("a"), f(-0.0, 1).alias("b"), f(0.0, 1, positive="+").alias("c"), f(-8e-8).alias("d"), f(-0.01, accuracy=0.05, precision=2).alias("e"), fmt.human(F.lit(-0.0), "B").alias("f"))
    assert tuple(got) == ("-0.00", "-0.0", "+0.0", "-0", "-0.00", "0 B")


def test_normal_forms_in_one_pass(spark):
    import unicodedata

    texts = [None, "", "plain", "é", "é", "ﬁ", "Ạ̊", "Å", "한글", "한", "𝔸", "İ", "K"] * 11
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string").repartition(1)
    n, c = text.normalize, F.col("s")
    df = df.select("id", n(c).alias("a"), n(c, "NFD", "NFC").alias("b"), n(F.lower(c), "NFKD", "NFC").alias("k"), text.normal_form_settled(c, "NFKC").alias("t"))
    u = unicodedata.normalize
    got = sorted(tuple(r) for r in df.collect())
    lower = [None if s is None else r[0] for s, r in zip(texts, spark.createDataFrame(list(enumerate(texts)), "id long, s string").repartition(1).orderBy("id").select(F.lower("s")).collect())]
    assert got == [(i, *((None,) * 4 if s is None else (u("NFC", s), u("NFC", u("NFD", s)), u("NFC", u("NFKD", lo)), True))) for i, (s, lo) in enumerate(zip(texts, lower))]
    with pytest.raises(ValueError):
        n(c, "NFC", "NFX")


def test_text_normal_forms_sends_texts_to_python_once(spark):
    from tessera.plans import catalog

    plan = catalog.QUERIES["text_normal_forms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_stab_join_shuffles_no_points_for_few_intervals(spark, monkeypatch):
    rng = random.Random(8)
    spans = [(i, a := rng.uniform(0, 5), a + rng.choice([0.0, 20.0, 20.0, 900.0])) for i in range(60)] + [(60, 5.0, 4.0), (61, None, 3.0)]
    places = [rng.uniform(-50, 950) for _ in range(300)] + [a for _, a, _ in spans[:20]] + [None, float("nan"), 1e300]
    s = spark.createDataFrame(spans, "i long, a double, b double")
    p = spark.createDataFrame(list(enumerate(places)), "p long, x double").repartition(3)
    want = sorted((k, i) for k, x in enumerate(places) if x is not None for i, a, b in spans if a is not None and a <= x <= b)
    for most in (100_000, 0):
        monkeypatch.setattr(intervals, "SENT_INTERVALS", most)
        got = intervals.stab_join(p, s, "x", "a", "b")
        assert sorted((r["p"], r["i"]) for r in got.collect()) == want
        assert ("strategy=broadcast" in got._jdf.queryExecution().optimizedPlan().toString()) == bool(most)
        assert intervals.stab_join(p, s.limit(0), "x", "a", "b").count() == 0


def test_stab_join_of_deep_intervals_makes_small_files(spark, tmp_path):
    rows = spark.range(30_000).select(F.col("id").alias("i"), (F.col("id") % 20).cast("double").alias("a")).withColumn("b", F.col("a") + 500 + F.col("i") % 2)
    far = spark.createDataFrame([(30_000, -1e9, -1e9 + 400.0)], "i long, a double, b double")  # one alone, far away
    p = spark.range(40).select(F.col("id").alias("p"), (F.col("id") * 15.0).alias("x")).repartition(2)
    out = str(tmp_path / "out")
    intervals.stab_join(p, rows.unionByName(far), "x", "a", "b").select("p", "i").write.parquet(out)
    got = spark.read.parquet(out).groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("i").alias("d"), F.sum("i").alias("s")).collect()
    want = {k: [i for i in range(30_000) if i % 20 <= 15 * k <= i % 20 + 500 + i % 2] for k in range(40)}
    assert {r["p"]: (r["n"], r["d"], r["s"]) for r in got} == {k: (len(v), len(v), sum(v)) for k, v in want.items() if v}
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < sum(map(len, want.values()))  # less than a byte a row


def test_stab_join_in_blocks_keeps_every_pair(spark, monkeypatch):
    rng = random.Random(9)
    spans = [(i, a := rng.choice([0.0, rng.uniform(-30, 30)]), a + rng.choice([0.0, 3.0, 20.0, 900.0])) for i in range(90)] + [(90, 5.0, 4.0), (91, None, 3.0), (92, 2.0, None)]
    places = [rng.uniform(-50, 950) for _ in range(200)] + [a for _, a, _ in spans[:20]] + [None, float("nan"), 1e300, 0.0, 0.0]
    s, p = spark.createDataFrame(spans, "i long, a double, b double"), spark.createDataFrame(list(enumerate(places)), "p long, x double").repartition(3)
    want = sorted((k, i) for k, x in enumerate(places) if x is not None for i, a, b in spans if a is not None and b is not None and a <= x <= b)
    monkeypatch.setattr(intervals, "DEEP", -1)
    for block, tasks in ((1, 64), (7, 2), (256, 64)):
        monkeypatch.setattr(intervals, "BLOCK", block)
        monkeypatch.setattr(intervals, "BLOCK_TASKS", tasks)
        got = intervals.stab_join(p, s, "x", "a", "b")
        assert got.columns == ["p", "x", "i", "a", "b"] and sorted((r["p"], r["i"]) for r in got.collect()) == want
    assert intervals.stab_join(p, s.limit(0), "x", "a", "b").count() == 0
