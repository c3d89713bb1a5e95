"""The analysis with the sequence ratio and the margin, which SQL can't express, against a plain-Python model of it."""

import os
from collections import Counter
from difflib import SequenceMatcher
from functools import cmp_to_key
from itertools import combinations
from statistics import median

import pytest
from pyspark.sql import functions as F

from tomeweave import queries
from tomeweave.operators import matching
from tomeweave.plans.engine import analyze
from tomeweave.plans.options import Options

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
RANK = {"zip": 4, "7z": 3, "rar": 2, "folder": 1}


def pairs_of(text):
    return {text[i : i + 2] for i in range(len(text) - 1)} or {text}


def alike(a, b):
    """(score, method) of two series, in this order."""
    if not a or not b:
        return (1.0, "volume_only") if a == b else (0.7, "one_sided")
    if a == b:
        return 1.0, "equal"
    short, long = sorted((a, b), key=len)
    x, y = pairs_of(a), pairs_of(b)
    found = [("substring", 0.9 if len(short) >= 4 and short in long else -1.0), ("sequence", SequenceMatcher(None, a, b).ratio()), ("bigram", 2 * len(x & y) / (len(x) + len(y)))]
    best = max(s for _, s in found)
    return best, next(m for m, s in found if s == best)


class Sets:
    def __init__(self, members):
        self.up = {m: m for m in members}

    def find(self, m):
        while self.up[m] != m:
            m = self.up[m]
        return m

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


@pytest.fixture(scope="module")
def measured(spark):
    return queries._measured(spark, SF, adopt=False).cache()


@pytest.fixture(scope="module")
def items(measured):
    rows = [r.asDict() for r in measured.orderBy("item_id").collect()]
    for scope in {r["scope"] for r in rows}:
        own = [r for r in rows if r["scope"] == scope and r["volume"] is not None]
        series = {r["series"] for r in own if r["series"]}
        if len(series) == 1:
            for r in own:
                r["series"] = r["series"] or next(iter(series))
    return rows


@pytest.fixture(scope="module")
def result(measured):
    return analyze(measured, Options(retry_overflow=False, fallback_series="catalogue"))


@pytest.fixture(scope="module")
def grouped(items):
    """(sets, least accepted score by group, reviews) over all pairs in a block."""
    sets, edges, reviews = Sets([r["item_id"] for r in items]), [], set()
    for a, b in combinations(items, 2):
        if (a["volume_kind"], a["volume"], sorted(a["editions"])) == (b["volume_kind"], b["volume"], sorted(b["editions"])):
            score, method = alike(a["series"], b["series"])
            if score >= 0.85:
                sets.join(a["item_id"], b["item_id"])
                edges.append((a["item_id"], score))
            elif score >= 0.65:
                reviews.add((a["item_id"], b["item_id"], round(score, 9), method))
    least = {}
    for i, score in edges:
        least[sets.find(i)] = min(score, least.get(sets.find(i), 1.0))
    return sets, least, reviews


def test_groups_and_reviews(items, result, grouped):
    sets, least, reviews = grouped
    got = {r.item_id: (r.group_id, round(r.similarity, 9)) for r in result.groups.collect()}
    assert got == {r["item_id"]: (sets.find(r["item_id"]), round(least.get(sets.find(r["item_id"]), 1.0), 9)) for r in items}
    assert {(r.left_id, r.right_id, round(r.similarity, 9), r.method) for r in result.reviews.collect()} == reviews


def test_scores(spark):
    words = ["", "a", "night", "nacht", "tide", "diet", "smallring", "small ring", "ringsmall", "smallrings", "氷剣の魔術師", "氷剣", "あいうえお", "x" * 12, "xyxyxyxyxyxy"]
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "canon_l string, canon_r string")
    for least in (0.0, 0.65, 0.85):
        for r in matching.scored(rows, least).where(F.col("score") >= least).collect():
            want = alike(r.canon_l, r.canon_r)
            assert want[0] >= least and (round(r.score, 9), r.method) == (round(want[0], 9), want[1])


def odd_sizes(items):
    """Rule of each item whose size is far from its folder's or the job's median."""
    able = [r for r in items if r["measured"] and r["total_bytes"] > 0]
    below = {}
    for r in able:
        parts = r["scope"].split("/") if r["scope"] else []
        for d in range(len(parts) + 1):
            below.setdefault(tuple(parts[:d]), []).append(r["total_bytes"])
    out = {}
    for r in able:
        parts = tuple(r["scope"].split("/")) if r["scope"] else ()
        near = next((below[parts[:d]] for d in range(len(parts), -1, -1) if len(below[parts[:d]]) >= 4), None)
        if near:
            ratio = r["total_bytes"] / median(near)
            if ratio < 0.25 or ratio > 4:
                out[r["item_id"]] = "small" if ratio < 0.25 else "large"
                continue
        if len(able) >= 4 and r["total_bytes"] / median(x["total_bytes"] for x in able) < 0.25:
            out[r["item_id"]] = "small_overall"
    return out


def better(a, b):
    """(sign, what decides)"""
    for what in ("median_pixels", "median_bpp", "total_bytes"):
        x, y = a[what] or 0, b[what] or 0
        if max(x, y) > 0 and abs(x - y) / max(x, y) > 0.05:
            return (1 if x > y else -1), what
    for what, x, y in (("source_kind", RANK[a["kind"]], RANK[b["kind"]]), ("longer_name", len(a["name"]), len(b["name"])), ("name_order", b["name"], a["name"])):
        if x != y:
            return (1 if x > y else -1), what
    return 0, "equal"


@pytest.fixture(scope="module")
def decided(items, grouped):
    sets, _, _ = grouped
    groups, odd, out = {}, odd_sizes(items), {}
    for r in items:
        groups.setdefault(sets.find(r["item_id"]), []).append(r)
    for members in (m for m in groups.values() if len(m) > 1):
        able = [r for r in members if r["measured"]]
        flags = {r["item_id"]: odd[r["item_id"]] for r in able if r["item_id"] in odd}
        if len(able) > 1:
            pages, size = max(r["page_count"] for r in able), max(r["total_bytes"] for r in able)
            for r in able:
                if r["page_count"] < 0.3 * pages:
                    flags[r["item_id"]] = "few_pages"
                elif r["total_bytes"] < 0.25 * size:
                    flags[r["item_id"]] = "small_in_group"
        if len(flags) == len(able):
            flags = {}
        for r in members:
            if not r["measured"]:
                out[r["item_id"]] = ("undecided", "unmeasured", None)
            elif r["item_id"] in flags:
                out[r["item_id"]] = ("loser", "outlier:" + flags[r["item_id"]], None)
        ordered = sorted((r for r in able if r["item_id"] not in flags), key=cmp_to_key(lambda a, b: -better(a, b)[0]))
        for k, r in enumerate(ordered):
            if k:
                out[r["item_id"]] = ("loser", better(ordered[0], r)[1], ordered[0]["item_id"])
            else:
                out[r["item_id"]] = ("winner", "/".join(sorted({better(r, x)[1] for x in ordered[1:]})) or "nothing_to_compare", None)
    return out


def test_decisions(result, decided):
    assert {r.item_id: (r.role, r.reason_code, r.reason_item) for r in result.decisions.collect()} == decided


def test_names_and_evidence(items, result, grouped, decided):
    sets, least, reviews = grouped
    alive, seen = [], set()
    for r in items:
        if decided.get(r["item_id"], ("",))[0] != "loser" and r["rel_path"] not in seen:
            seen.add(r["rel_path"])
            alive.append(r)
    sizes = Counter(sets.find(r["item_id"]) for r in items)
    voters = [r for r in items if r in alive or sizes[sets.find(r["item_id"])] > 1]
    first = {}
    for r in voters:
        if r["series"]:
            first.setdefault((r["series"], ",".join(r["editions"])), r["item_id"])
    clusters = Sets([r["item_id"] for r in items])
    for r in voters:
        if r["series"]:
            clusters.join(first[r["series"], ",".join(r["editions"])], r["item_id"])
        if sizes[sets.find(r["item_id"])] > 1:
            clusters.join(sets.find(r["item_id"]), r["item_id"])
    for (a, e), (b, f) in combinations(first, 2):
        if e == f and alike(a, b)[0] >= 0.85:
            clusters.join(first[a, e], first[b, f])
    named = [r for r in voters if r["series"]]
    labels = {}
    for c in {clusters.find(r["item_id"]) for r in named}:
        votes = Counter(r["display"] for r in named if clusters.find(r["item_id"]) == c and r["display"])
        labels[c] = min(votes, key=lambda n: (not any("぀" <= x <= "鿿" for x in n), -votes[n], -len(n), n)) if votes else None
    count = Counter(clusters.find(r["item_id"]) for r in named)
    smallest = {c: min(r["item_id"] for r in named if clusters.find(r["item_id"]) == c) for c in count}
    default = labels[min(count, key=lambda c: (-count[c], smallest[c]))] or "catalogue"
    want = {}
    for r in alive:
        label = (labels.get(clusters.find(r["item_id"])) if r["series"] else None) or default
        want[r["item_id"]] = f"{label} 第{int(r['volume']):02d}巻"
    assert {r.item_id: r.unified_name for r in result.names.collect()} == want
    by_id = {r["item_id"]: r for r in items}
    shown = lambda i: (by_id[i]["rel_path"], by_id[i]["page_count"], f"{by_id[i]['median_pixels'] or 0:.0f}", f"{by_id[i]['median_bpp'] or 0:.4f}")
    rows = Counter(
        (f"number:{by_id[i]['volume']}:#{sets.find(i)}", {"undecided": "pending"}.get(role, role), *shown(i), f"{least.get(sets.find(i), 1.0):.2f}", why, "planned" if role == "loser" else "keep") for i, (role, why, _) in decided.items()
    )
    for a, b, score, method in reviews:
        for i, other in ((a, b), (b, a)):
            rows["review", "pending", *shown(i), f"{score:.2f}", f"{method}:{other}", "skipped"] += 1
    columns = ("group", "role", "path", "pages", "median_pixels", "bytes_per_pixel", "similarity", "reason", "result")
    assert Counter(tuple(r[c] for c in columns) for r in result.evidence.collect()) == rows
    summary = result.summary.first()
    roles = Counter(role for role, _, _ in decided.values())
    assert (summary.n_items, summary.n_losers, summary.n_undecided, summary.n_reviews) == (len(items), roles["loser"], roles["undecided"], len(reviews))
    assert summary.n_duplicate_groups == sum(n > 1 for n in sizes.values())
