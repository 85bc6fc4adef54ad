"""Closure, reconstruction, authored rows and canonical JSON against plain Python."""

import json
import random

from pyspark.sql import functions as F

from corpusweave.functions.authored import author_rows
from corpusweave.functions.canonical import canonical_json
from corpusweave.operators.graphs import reachable, reconstructed


def test_reachable_on_a_chain_a_cycle_and_a_random_graph(spark):
    rng = random.Random(5)
    edges = [(f"k{i}", f"k{i + 1}") for i in range(30)] + [("k30", "k3"), ("x", "y"), ("y", "x"), ("z", "k0"), (None, "k1"), ("k1", None)]
    edges += [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(80)]
    roots = [("k0",), ("r1",), ("lone",), ("k0",), (None,)]
    depth, front = {r: 0 for (r,) in roots if r}, {r for (r,) in roots if r}
    for d in range(1, 99):
        front = {b for a, b in edges if a in front and b} - depth.keys()
        depth |= dict.fromkeys(front, d)
    got = reachable(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame(roots, "node string"))
    assert {r["node"]: r["depth"] for r in got.collect()} == depth and got.count() == len(depth)
    assert len(got._jdf.queryExecution().toString()) < 5000  # one scan, whatever the number of rounds
    assert reachable(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([], "node string")).count() == 0


def test_reconstruction_of_a_dag_and_a_cycle(spark):
    bodies = {"a": "[[b]] and [[c]][[c]]", "b": "<[[d]]>", "c": "", "d": "d$1\\ [x]", "e": "[[e]]", "f": "[[g]] [[d]]", "g": "[[f]]", "h": "[[nothing]]-[[d]]", "i": "[[e]]", "top": "[[a]]|[[h]]|", "n": None}
    bodies |= {f"l{i}": f"{i}[[l{i + 1}]]" for i in range(12)} | {"l12": "end"}
    d = bodies["d"]
    want = {k: v or "" for k, v in bodies.items()} | {"b": f"<{d}>", "a": f"<{d}> and ", "h": f"[[nothing]]-{d}", "top": f"<{d}> and |[[nothing]]-{d}|"}
    want |= {f"l{i}": "".join(map(str, range(i, 12))) + "end" for i in range(12)}
    got = reconstructed(spark.createDataFrame([*bodies.items(), ("b", "zz"), (None, "x")], "key string, body string"))
    rows = got.collect()
    assert {r["key"]: r["text"] for r in rows} == want and len(rows) == len(want)


def test_authored_rows(spark):
    class Halves:
        """Emits a row for each half of an even number, and fails in the middle of numbers that 3 divides."""

        def __init__(self):
            self.seen = 0

        def take(self, row):
            self.seen += 1
            yield "nth", self.seen
            if row.seq % 3 == 0:
                raise KeyError(row.seq)
            if row.seq % 2 == 0:
                yield "half", row.seq / 2
                yield "none", None

    events = [(k, s) for k in (1, 2, None) for s in range(20)]
    random.Random(1).shuffle(events)
    got = author_rows(spark.createDataFrame(events, "key long, seq long"), Halves, "key", "seq")
    want = []
    for k in (1, 2, None):
        for s in range(20):
            want.append((k, s, "nth", float(s + 1), None))
            if s % 3 == 0:
                want.append((k, s, "exception", None, f"KeyError: {s}"))
            elif s % 2 == 0:
                want += [(k, s, "half", s / 2, None), (k, s, "none", None, None)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert author_rows(spark.createDataFrame([], "key long, seq long"), Halves, "key", "seq").count() == 0


def random_json(rng, depth):
    kind = rng.randrange(7 if depth else 5)
    if kind < 5:
        return rng.choice([None, True, False, rng.randrange(-(10**12), 10**12), rng.randrange(999) / 8, "é\n\"\\/\t ", "", "日本", "😀", "\x7f"])
    if kind == 5:
        return [random_json(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "B", "é", "a b", 'q"', "z\n", "10", "9"]) + str(rng.randrange(3)): random_json(rng, depth - 1) for _ in range(rng.randrange(5))}


def test_canonical_json(spark):
    rng = random.Random(7)
    values = [random_json(rng, 4) for _ in range(300)]
    rows = [(i, json.dumps(v, indent=rng.choice([None, 2]), ensure_ascii=bool(i % 2))) for i, v in enumerate(values)]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(rows, "i long, t string").select("i", canonical_json(F.col("t")).alias("c")).collect()}
    for i, v in enumerate(values):
        assert json.loads(got[i]) == v
        want = json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert got[i] == want or "." in want, (got[i], want)
    bad = spark.createDataFrame([("{",), ("",), (None,), ('{"a":1,"a":2}',)], "t string").select(canonical_json(F.col("t")).alias("c")).collect()
    assert all(r["c"] is None for r in bad)


def records_shuffled(spark, work):
    """The work's result, and how many rows it wrote to shuffles; every join is a merge meanwhile."""
    store = spark.sparkContext._jsc.sc().statusStore()
    seen = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for stages in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for i in range(stages.size()))}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = seen()
        out = work().collect()
        return out, sum(n for k, n in seen().items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rounds_of_reconstruction_do_not_move_waiting_texts_again(spark):
    pieces = [(f"c{i}", f"{i}[[c{i + 1}]]") for i in range(8)] + [("c8", "end")] + [(f"p{i}", f"<{i}>") for i in range(100)]
    pieces += [(f"o{i}", "[[c0]]" + "".join(f"[[p{(i + j) % 100}]]" for j in range(30))) for i in range(100)]
    rows, n = records_shuffled(spark, lambda: reconstructed(spark.createDataFrame(pieces, "key string, body string")))
    got = {r["key"]: r["text"] for r in rows}
    assert got["o7"] == "01234567end" + "".join(f"<{(7 + j) % 100}>" for j in range(30)) and len(got) == len(pieces)
    assert n < 4 * 3100, n  # 3,100 places of names, and ten rounds


def test_rounds_of_reach_do_not_move_edges_again(spark):
    edges = [(f"k{i}", f"k{i + 1}") for i in range(8)] + [(f"x{i % 50}", f"y{i}") for i in range(3000)]
    rows, n = records_shuffled(spark, lambda: reachable(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([("k0",)], "node string")))
    assert {r["node"]: r["depth"] for r in rows} == {f"k{i}": i for i in range(9)}
    assert n < 2 * 3000, n  # nine rounds
