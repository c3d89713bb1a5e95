import os
import random

import pytest
from pyspark.sql import functions as F

from tomeweave.operators import matching, measure, outliers, overflow, winners
from tomeweave.operators import cluster
from tomeweave.operators.cluster import connected_components
from tomeweave.plans import actions, storage
from tomeweave.plans.engine import analyze, titled
from tomeweave.plans.options import Options
from tomeweave.sources.catalogue import load_aliases


def make(spark, names, **metrics):
    """Items from names, or (path, metrics)."""
    base = {"kind": "zip", "page_count": 100, "total_bytes": 10_000_000, "median_pixels": 1e6, "median_bpp": 0.5, "measured": True} | metrics
    rows = []
    for i, n in enumerate(names):
        path, own = n if isinstance(n, tuple) else (n, {})
        rows.append({"item_id": i, "rel_path": path, "name": path.rsplit("/", 1)[-1]} | base | own)
    schema = "item_id bigint, rel_path string, name string, kind string, page_count int, total_bytes bigint, median_pixels double, median_bpp double, measured boolean"
    return titled(spark.createDataFrame(rows, schema))


def groups_of(spark, names, options=None, adopt=True):
    items = make(spark, names)
    items = matching.adopt_scope_series(items, options.aliases if options else None) if adopt else items
    groups, reviews = matching.group_items(items, options)
    found: dict = {}
    for r in groups.collect():
        found.setdefault(r.group_id, set()).add(r.item_id)
    return sorted(map(sorted, found.values())), [(r.left_id, r.right_id, round(r.similarity, 2), r.method) for r in reviews.collect()]


def test_groups(spark):
    assert groups_of(spark, ["第7巻", "07", "第8巻"]) == ([[0, 1], [2]], [])
    groups, reviews = groups_of(spark, ["第7巻", "作品名 第7巻", "まったく別の本 第1巻"])
    assert groups == [[0], [1], [2]] and reviews == [(0, 1, 0.7, "one_sided")]
    assert groups_of(spark, ["第7巻", "作品名 第7巻", "作品名 第8巻"]) == ([[0, 1], [2]], [])
    assert groups_of(spark, ["作品名 第10巻", "作品名 完全版 第10巻"])[0] == [[0], [1]]
    assert groups_of(spark, ["作品名", "別作品"]) == ([], [])


def test_approval_and_aliases(spark):
    names = ["第7巻", "作品名 第7巻", "別の物語 第1巻"]
    assert groups_of(spark, names, Options(accept_review=True))[0] == [[0, 1], [2]]
    assert groups_of(spark, names, Options(approved=frozenset({frozenset(names[:2])}))) == ([[0, 1], [2]], [])
    aliases = load_aliases('{"ONE PIECE": ["ワンピース"]}')
    assert groups_of(spark, ["ワンピース 第7巻", "ONE PIECE 07"], Options(aliases=aliases))[0] == [[0, 1]]
    for bad in ("[]", "{", '{"a": 1}'):
        with pytest.raises(ValueError):
            load_aliases(bad)


def test_scores(spark):
    pairs = [("あいうえおかきくけこ", "あいうえおかきくけこさしすせそ"), ("tide", "diet"), ("", "x"), ("", ""), ("abc", "abc")]
    rows = matching.scored(spark.createDataFrame(pairs, "canon_l string, canon_r string")).collect()
    by = {(r.canon_l, r.canon_r): (round(r.score, 3), r.method) for r in rows}
    assert by[pairs[0]] == (0.9, "substring") and by[pairs[1]] == (0.25, "sequence")
    assert by[pairs[2]][0] == 0.7 and by[pairs[3]] == (1.0, "volume_only") and by[pairs[4]] == (1.0, "equal")


def test_work_folders_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(storage, "_MADE", [])
    table = storage.materialize(spark.range(5))
    assert table.count() == 5 and storage.work_dir(spark) and storage.remove_work() == 1  # the second was never written to
    assert storage.remove_work() == 0
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|NOT_EXIST"):
        spark.range(1).crossJoin(table).count()


@pytest.mark.parametrize("at_once", [1 << 18, 0])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(cluster, "ONE_TASK", at_once)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, 2000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_overflow(spark):

    def run(names):
        items = make(spark, names)
        groups, reviews = matching.group_items(items)
        groups, reviews = overflow.retry_overflow(groups, reviews, items)
        found: dict = {}
        for r in groups.collect():
            found.setdefault(r.group_key, set()).add(r.item_id)
        return found

    four = ["Hyoken v01.zip", "Hyoken v02.zip", "氷剣の魔術師 第01巻.zip", "氷剣の魔術師 第02巻.zip"]
    assert sorted(map(sorted, run(four).values())) == [[0, 2], [1, 3]]
    apart = run([f"root/w{i}/{n}" for i, n in enumerate(four)])
    assert sorted(map(sorted, apart.values())) == [[0, 2], [1, 3]] and all(k.endswith("#relaxed:root") for k in apart)
    assert len(run(["作品A 第01巻.zip", "作品B 第02巻.zip", "作品C 第03巻.zip"])) == 3


def winner(spark, members, **options):
    items = make(spark, [("作品名 第01巻.zip" if i == 0 else f"作品名 v{'0' * i}1.zip", m) for i, m in enumerate(members)])
    groups = items.select("item_id", F.lit("g").alias("group_key"), F.col("item_id").alias("pos"))
    thin = outliers.thin_members(groups.join(items, "item_id"))
    return {r.item_id: (r.role, r.reason_code) for r in winners.select_winners(groups, items, thin, **options).collect()}


def test_winners(spark):
    assert winner(spark, [{"median_pixels": 880_000.0}, {"median_pixels": 3.5e6, "page_count": 75}])[1] == ("winner", "median_pixels")
    assert winner(spark, [{"median_bpp": 0.4}, {"median_bpp": 0.2}])[0] == ("winner", "median_bpp")
    assert winner(spark, [{"kind": "folder"}, {"kind": "zip"}])[1] == ("winner", "source_kind")
    out = winner(spark, [{}, {"measured": False}])
    assert out[0][0] == "winner" and out[1] == ("undecided", "unmeasured")
    assert winner(spark, [{"page_count": 60}, {"page_count": 3, "median_pixels": 9e6}])[0][0] == "winner"
    assert winner(spark, [{"page_count": 20}, {"page_count": 15}, {"median_pixels": 2e6}])[2][0] == "winner"


def test_verify_content():
    base = {"pos": 0, "measured": True, "median_pixels": 1.0, "median_bpp": 1.0, "total_bytes": 1, "rank": 4, "label": "a", "outlier": None}
    rows = winners.decide([base | {"item_id": 1, "hashes": [0, 0]}, base | {"item_id": 2, "label": "bb", "hashes": [-1, -1]}], 0.05, True, 6)
    assert sorted(r[:3] for r in rows) == [(1, "undecided", "content_differs"), (2, "winner", "content_separated")]


def test_pairwise_columns_agree(spark):
    rng = random.Random(1)
    names = [*winners.METRICS, "rank", "label"]
    side = lambda: [rng.choice([1.0, 1.03, 2.0]), rng.choice([0.1, 0.2]), rng.choice([10.0, 20.0]), rng.choice([1, 4]), rng.choice(["a", "bb", "ab"])]
    rows = [side() + side() for _ in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{n}_{s} {'string' if n == 'label' else 'int' if n == 'rank' else 'double'}" for s in "lr" for n in names))
    sign, why = winners.pairwise({n: F.col(f"{n}_l") for n in names}, {n: F.col(f"{n}_r") for n in names}, 0.05)
    for r in df.select("*", sign.alias("s"), why.alias("w")).collect():
        assert (r.s, r.w) == winners.compare({n: r[f"{n}_l"] for n in names}, {n: r[f"{n}_r"] for n in names}, 0.05)


def test_outliers(spark):
    mb = 1_000_000
    items = make(spark, [(f"a/x v0{i}.zip", {"total_bytes": 6 * mb}) for i in range(1, 5)] + [("a/b/x v05.zip", {"total_bytes": mb}), ("a/x v1-9.zip", {"total_bytes": 60 * mb})])
    assert [(r.item_id, r.rule) for r in outliers.size_outliers(items).collect()] == [(4, "small")]
    assert outliers.size_outliers(make(spark, [("x v01.zip", {"total_bytes": mb}), ("x v02.zip", {"total_bytes": 9 * mb})])).count() == 0


def test_sample_positions(spark):
    get = lambda n, k: spark.range(1).select(measure.sample_positions(F.lit(n), k).alias("x")).first()["x"]
    for n in (0, 1, 5, 16, 17, 222):
        want = list(range(n)) if n <= 16 else sorted({round(i * (n - 1) / 15) for i in range(16)})
        assert get(n, 16) == want
    assert get(9, 1) == [0] and get(0, 1) == []


def test_analysis_is_a_partition_and_survives_repartition(spark):
    rng = random.Random(2)
    names = [(f"f{rng.randrange(3)}/{rng.choice(['alpha', 'alphb', 'gamma delta', ''])} v{rng.randrange(1, 6):02d}.zip", {"median_pixels": rng.choice([1e6, 2e6]), "total_bytes": rng.choice([10**6, 10**7])}) for _ in range(60)]
    names = list({n[0]: n for n in names}.values())
    runs = []
    for parts in (1, 5):
        r = analyze(make(spark, names).repartition(parts), Options(fallback_series="x", language="en"))
        groups, decisions = r.groups.collect(), r.decisions.collect()
        assert sorted(g.item_id for g in groups) == sorted(i.item_id for i in r.items.where("volume is not null").collect())
        many = {k for k in (g.group_key for g in groups) if sum(g.group_key == k for g in groups) > 1}
        assert sorted(d.item_id for d in decisions) == sorted(g.item_id for g in groups if g.group_key in many)
        flat = r.flat.collect()
        assert len({f.destination for f in flat}) == len(flat) == r.survivors.count()
        assert r.summary.first().n_losers == r.actions.count()
        runs.append((sorted(map(tuple, decisions)), sorted(map(tuple, flat)), sorted(map(tuple, r.evidence.collect()))))
    assert runs[0] == runs[1]


def test_options():
    for bad in ({"sample": 0}, {"margin": 1.0}, {"review": 0.9}, {"language": "xx"}, {"rar_level": 9}):
        with pytest.raises(ValueError):
            Options(**bad).checked()


def test_intermediate_tables_have_neither_checksum_files_nor_marks(spark):
    df = storage.materialize(spark.range(10, numPartitions=2))
    (folder,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    names = os.listdir(folder.removeprefix("file://"))
    assert len(names) == 2 and all(n.startswith("part-") for n in names)  # each file more is a process more of its JVM
    assert sorted(r.id for r in df.collect()) == list(range(10))


@pytest.mark.parametrize("approved", [frozenset(), frozenset({("b/Night Tide v1.zip", "c/Knight Ride v1.zip")})])
def test_review_ends_without_pairs_of_items(spark, approved):
    names = [f"{d}/{n} v{v}.zip" for d in "abc" for n in ("Night Tide", "Knight Ride", "Knight Tidal", "Day") for v in (1, 2)] + ["a/第1巻.zip", "b/第1巻.zip"]
    options = Options(approved=approved, retry_overflow=False)
    items = matching.adopt_scope_series(make(spark, [(n, {}) for n in names]))
    _, reviews, gray = matching.grouped_with_gray(items, options)
    shown = actions.shown(items)
    want = sorted(map(tuple, actions.ends_of(reviews, shown).select("item_id", "path", "pages", "similarity", "method", "other").collect()))
    got = matching.review_ends(gray, items, shown, options)
    assert sorted(map(tuple, got.select("item_id", "path", "pages", "similarity", "method", "other").collect())) == want
    assert len(want) > 20 and any(r[4] == "one_sided" for r in want)
    result = analyze(make(spark, names), options)
    assert result.evidence.where("`group` = 'review'").count() == len(want)
    plan = result.evidence._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row of a pair is taken apart and joined to its items again
