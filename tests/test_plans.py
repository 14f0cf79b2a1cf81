"""Registered inspection queries against their SQL, and greedy clustering against the rule itself."""

import glob
import os

import duckdb
import pytest
from grainsight.functions import names
from grainsight.operators import capture, dedup, graph, report, review, spatial
from grainsight.plans import photo_queries, queries  # noqa: F401 - the first registers more queries
from grainsight.plans.relations import detections
from pyspark.sql import functions as F


def brute_force(rows, radius, fraction=0.0):
    """(id, seed) by the greedy rule itself, one row after the other."""
    order = sorted(rows, key=lambda r: (-r["confidence"], r["source_tile"], r["y"], r["x"], r["id"]))
    free = {r["id"] for r in order}
    for seed in order:
        if seed["id"] not in free:
            continue
        for r in order:
            limit = max(radius, fraction * max(seed["size"], r["size"])) if fraction > 0 else radius
            if r["id"] in free and (seed["x"] - r["x"]) ** 2 + (seed["y"] - r["y"]) ** 2 <= limit * limit:
                free.discard(r["id"])
                yield r["id"], seed["id"]


def rows_of(frame):
    text = lambda v: f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    names_ = sorted(frame)
    return names_, sorted(tuple(text(x.item() if hasattr(x, "item") else x) for x in r) for r in frame[names_].itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, small, name):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    want = con.execute(queries.ORACLES[name]).df()
    assert rows_of(queries.QUERIES[name](spark, small).toPandas()) == rows_of(want)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_without_sql(spark, small, name):
    """They run, and give rows."""
    assert queries.QUERIES[name](spark, small).count() > 0


@pytest.mark.parametrize("radius, fraction", [(60.0, 0.0), (24.0, 0.001)])
def test_greedy(spark, small, radius, fraction):
    det = detections(spark, small).where("id < 1000").select("id", "x", "y", "size", "confidence", "source_tile")
    want = dict(brute_force([r.asDict() for r in det.collect()], radius, fraction))
    assert {r.id: r.seed for r in dedup.assign_seeds(det, radius, fraction).collect()} == want
    assert sum(a != b for a, b in want.items()) > 10


@pytest.mark.parametrize("rounds", [0, 1, 8])
def test_greedy_chain(spark, rounds):
    """A chain of ever better detections, decided in rounds and by component."""
    chain = [(i, 5.0 * i, 0.0, 1.0, float(i % 97), "t") for i in range(300)]
    df = spark.createDataFrame(chain, "id long, x double, y double, size double, confidence double, source_tile string")
    want = dict(brute_force([r.asDict() for r in df.collect()], 6.0))
    assert {r.id: r.seed for r in dedup.assign_seeds(df, 6.0, rounds=rounds).collect()} == want


def test_limited_pairs(spark):
    """Sizes over many powers of two, one of them huge; both ways, each pair once."""
    import random

    rng = random.Random(3)
    rows = [(i, rng.uniform(0, 300), rng.uniform(0, 300), 10 ** rng.uniform(-1, 2.3)) for i in range(150)] + [(999, 150.0, 150.0, 2000.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, size double")
    for radius, fraction in ((5.0, 0.4), (5.0, 0.0), (0.0, 0.4)):
        got = [(r.a, r.b) for r in spatial.limited_pairs(df, radius, fraction).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).collect()]
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= max(radius, fraction * max(a[3], b[3])) ** 2}
        assert len(got) == len(set(got)) and set(got) == want


def test_slot_clusters(spark):
    """At most one member a slot, the nearest first; tiles without a slot are never taken."""
    rows = [(1, 0.0, 0.0, 5.0, 9.0, "N.png"), (2, 3.0, 0.0, 5.0, 8.0, "S.png"), (3, 1.0, 0.0, 5.0, 7.0, "S.png"), (4, 1.0, 1.0, 5.0, 6.0, "other.png"), (5, 100.0, 0.0, 5.0, 1.0, "E.png")]
    df = spark.createDataFrame(rows, "id long, x double, y double, size double, confidence double, source_tile string")
    assert {r.id: r.seed for r in dedup.assign_slot_seeds(df, 8.0, 0.0).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    merged = {r.id: (r.nsew_count, r.nsew_dirs) for r in dedup.deduplicate_slots(df, 8.0, fraction=0.0).collect()}
    assert merged[1] == (2, "N,S")


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in graph.connected_components(edges).collect()} == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}


def test_empty(spark, small):
    none = detections(spark, small).where("false")
    assert report.summary(none).head().asDict() == {"n": 0, "mean": 0.0, "std": 0.0, "min": 0.0, "max": 0.0}
    assert [r.n for r in report.at_least(none).collect()] == [0] * 5
    assert spatial.neighbour_counts(none, 5.0).count() == 0
    assert dedup.assign_seeds(none, 5.0).count() == 0


def test_names(spark):
    rows = [("v2/wafer_shot_0_quad1_exp200.png",), ("a/n.TIF",), ("(3,4)_w.png",), ("combi_2of4.png",), ("particles_only.png",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(names.slot("t").alias("slot"), names.quadrant("t").alias("q"), names.submap("t").alias("m")).collect()
    assert [r.slot for r in got] == ["QUAD1", "N", None, "COMBI", "PARTICLES_ONLY"]
    assert (got[0].q, got[0].m) == ("E", "v2")


def test_aliases(spark):
    df = spark.createDataFrame([("N_10_-20",)], "key string")
    found = {r.key for r in review.expand_keys(df).collect()}
    assert {"NSEW_10_-20", "S_10_-20"} <= found


def test_focus_finds_peak(spark, small):
    best = {r.run: r.best_offset_mm for r in queries.focus_replay(spark, small).collect()}
    assert best["up"] == pytest.approx(0.22, abs=0.01) and best["down"] == pytest.approx(-0.12, abs=0.01)


def test_scan_rejects(spark):
    with pytest.raises(ValueError):
        capture.scan_stops(spark, 0, 1, 1.0)


def test_settled_frames(spark):
    """The first frame after settling, not one of that very moment, in time; another camera's don't count."""
    frames = spark.createDataFrame([("a", i, float(i)) for i in range(5)] + [("b", 9, 9.2)], "camera string, seq long, at double")
    asks = spark.createDataFrame([("a", 1, 1.0, 1.5, 5.0), ("a", 2, 9.0, 0.1, 1.0), ("a", 3, 1.0, 1.0, 5.0), ("a", 4, 3.0, 0.5, 0.4), ("b", 5, 9.0, 0.1, 1.0)], "camera string, ask_id long, at double, settle_s double, timeout_s double")
    assert {r.ask_id: r.frame for r in capture.settled_frames(frames, asks).collect()} == {1: 3, 2: None, 3: 3, 4: None, 5: 9}


def test_combine_incomplete(spark, tmp_path):
    """Cells of one, two and three sides, short vectors and missing components are as in the SQL."""
    vectors = [(i, [((i * 31 + k * 17) % 200 - 100) / 90.0 for k in range(64)]) for i in (0, 1, 2, 3, 4, 8, 9, 13, 14, 15)]
    vectors += [(16, [0.5] * 40), (17, [None] + [0.25] * 63), (18, None), (19, [0.1] * 70)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries.QUERIES["combine_sides"](spark, str(tmp_path)).toPandas()
    assert len(got) == 5 * 64 and rows_of(got) == rows_of(con.execute(queries.ORACLES["combine_sides"]).df())


def test_cut_forgets_size(spark):
    """Estimated sizes don't multiply from round to round."""
    from grainsight.operators.checkpoint import cut

    rows = spark.range(10).withColumn("v", F.col("id") % 3)
    sizes = []
    for _ in range(4):
        rows = cut(rows.join(rows.select("id", F.col("v").alias("w")), "id").select("id", F.least("v", "w").alias("v")))
        sizes.append(int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length())
    assert rows.count() == 10 and max(sizes) <= 64


@pytest.mark.parametrize("radius", [0.0, 3.0, 40.0])
def test_nearest_dense(spark, radius):
    """The nearest of many: hot places, ties, groups, rows without a place; no row for each pair within reach."""
    import random

    rng = random.Random(5)
    place = lambda: rng.choice([(7.0, 7.0), (float(rng.randrange(-60, 60)), float(rng.randrange(-60, 60))), (rng.uniform(-300, 300), rng.uniform(-300, 300))])
    rows = [(i, *place(), rng.choice("ab")) for i in range(900)] + [(2000, None, 1.0, "a"), (2001, float("nan"), 1.0, "a"), (2002, 1.0, 1.0, None)]
    right = [(i + 5000, *place(), rng.choice("ab")) for i in range(700)] + [(9000, None, 1.0, "a"), (9001, float("inf"), 1.0, "a"), (9002, 1.0, 1.0, None)]
    schema = "id long, x double, y double, g string"
    got = spatial.nearest_join(spark.createDataFrame(rows, schema), spark.createDataFrame(right, schema), radius, ["g"])
    want = {}
    for i, x, y, g in rows[:900]:
        near = min(((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b, h in right[:700] if h == g)
        if near[0] <= radius * radius:
            want[i] = near
    assert {r.id: (r.d2, r.r.id) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and len(want) > 50


@pytest.mark.parametrize("radius, wide, rounds", [(0.0, 32, 8), (6.0, 4, 8), (6.0, 4, 0), (40.0, 32, 8)])
def test_greedy_dense(spark, monkeypatch, radius, wide, rounds):
    """Hot places, groups and rows without a place, over many blocks; no list of pairs, which grow with the square of the rows."""
    import random

    def pairs(*_):
        raise AssertionError("a list of all pairs")

    monkeypatch.setattr(dedup, "limited_pairs", pairs)
    monkeypatch.setattr(dedup, "BLOCK", wide)
    rng = random.Random(7)
    place = lambda: rng.choice([(48.0, 48.0), (float(rng.randrange(-50, 150)), float(rng.randrange(-50, 150))), (rng.uniform(-50, 150), rng.uniform(-50, 150))])
    rows = [(i, *place(), 1.0, float(rng.randrange(20)), rng.choice(["s", "t"]), rng.choice("ab")) for i in range(1200)]
    rows += [(5000, None, 1.0, 1.0, 50.0, "t", "a"), (5001, float("nan"), 1.0, 1.0, 50.0, "t", "a"), (5002, 48.0, 48.0, 1.0, 50.0, "t", None)]
    df = spark.createDataFrame(rows, "id long, x double, y double, size double, confidence double, source_tile string, g string")
    want = {i: i for i in (5000, 5001, 5002)}
    for g in "ab":
        want |= dict(brute_force([r.asDict() for r in df.where(F.col("g") == g).collect() if r.id < 5000], radius))
    assert {r.id: r.seed for r in dedup.assign_seeds(df, radius, on=["g"], rounds=rounds).collect()} == want


def on_edge(spark, folder, name, pixels):
    """(got, by SQL) of a table of one photo, whose pixels the SQL can add up in one order only."""
    spark.createDataFrame([(0, [(p + 0.5) / 127.5 - 1 for p in pixels])], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return [r.total for r in queries.QUERIES[name](spark, str(folder)).collect()], [r[1] for r in con.execute(queries.ORACLES[name]).fetchall()]


def test_unit_on_edge(spark, tmp_path):
    """The total is 38.35 in real numbers, less than that when its doubles are added one after the other."""
    pixels = bytes.fromhex("6a6d6e82807d74879d7175757f8c6c828b8c839574936f7f628e6a8491647e667b7b7b8b9d8c4d7c79737d8693707d7893666379897189887b7987769289658b")
    assert on_edge(spark, tmp_path, "photo_unit", pixels) == ([38.3], [38.3])


@pytest.mark.parametrize("pixels, total", [("89807d7c778e7b779d6f85a887757a767f8868697c7381916d6a688478a37e7f886f8d62868b7e6c6b7292899780748586778381798f8f7f905381888f7687a3", 31.2), ("8e81788b8c819868a2868490728d837f91687497819b7c7b937b7175867575937866778c6885817766a28d7f709d8275766780857f6f9b8c9c74687b73848c8e", 28.9)])
def test_stretched_on_edge(spark, tmp_path, pixels, total):
    """31.25 is missed by the order of addition; 28.849999999999998 is rounded up, as ten times that is 288.5 in doubles."""
    assert on_edge(spark, tmp_path, "photo_stretched", bytes.fromhex(pixels)) == ([total], [total])


@pytest.mark.parametrize("radius, rounds", [(8.0, 8), (8.0, 0), (0.0, 8)])
def test_slots_in_blocks(spark, monkeypatch, radius, rounds):
    """As by the rule over all rows of a group, one after the other, without a list of pairs; many at one place, some without one."""

    def no_pairs(*_):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(dedup, "limited_pairs", no_pairs)
    tiles = ["N.png", "S.png", "E.png", "v1/wafer_shot_0_quad2_exp9.png", "uniform.png"]
    rows = [(i, float(i * i * 31 % 601), float(i * i % 997 * (i % 911) % 613), 1.0, float(i * 7907 % 89), tiles[i * i % 17 % 5], "ab"[i % 7 == 0]) for i in range(4000)]
    rows += [(i, 300.0, 300.0, 1.0, float(i % 5), tiles[i % 5], "a") for i in range(4000, 4600)]
    rows += [(5000, None, 1.0, 1.0, 1.0, "N.png", "a"), (5001, float("nan"), 1.0, 1.0, 2.0, "S.png", "a"), (5002, 300.0, 300.0, 1.0, 1.0, "N.png", None)]
    df = spark.createDataFrame(rows, "id long, x double, y double, size double, confidence double, source_tile string, g string")
    frame = df.where("id < 5000").withColumn("slot", names.slot("source_tile")).toPandas()
    want = {5000: 5000, 5001: 5001, 5002: 5002}
    for _, group in frame.groupby("g"):
        found = dedup._slot_clusters(radius, 0.0)(group)
        want |= dict(zip(found["id"], found["seed"], strict=True))
    got = dedup.assign_slot_seeds(df, radius, 0.0, ["g"], rounds).collect()
    assert len(got) == len(want) and {r.id: r.seed for r in got} == want
    assert sum(a != b for a, b in want.items()) > 100
