"""Salary models against plain numpy on drawn postings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelens.operators import models, salary_models as sm, stats

SCHEMA = "salary_midpoint_k double, skills array<string>, city string, experience string, education string, company_size string, employment_type string, company_name string, company_key string, day date, confidence_band string"


def drawn(n=400, seed=4, bands=("高", "中", "低", None), skill=0.4):
    import datetime
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        skills = [s for s in ("x", "y", "z") if draw.random() < 0.5]
        city, kind = draw.choice(["a", "b", "b", "c"]), draw.choice(["全职", "全职", "实习"])
        pay = round(math.exp(2.3 + skill * ("x" in skills) + 0.3 * (city == "a") - 0.4 * (kind == "实习") + draw.gauss(0, 0.15)), 1)
        firm = f"firm{draw.randint(0, 30)}"
        rows.append((pay, skills, city, draw.choice(["1-3年", "3-5年"]), "本科", "20-99人", kind, firm, firm, datetime.date(2024, 1, 1) + datetime.timedelta(days=i % 40), draw.choice(bands)))
    return rows


def matrix(rows, spec):
    names = sm.feature_names(spec)
    x = np.zeros((len(rows), len(names)))
    for r, row in enumerate(rows):
        have = dict(zip(("city", "experience", "education", "company_size", "employment_type"), row[2:7]))
        on = {"intercept"} | {f"{c}:{v}" for c, v in have.items()} | {f"skill:{s}" for s in row[1]}
        on |= {n for n in names if n.split(":", 1)[0] in ("pair", "triple") and set(n.split(":", 1)[1].split(" + ")) <= set(row[1])}
        x[r] = [n in on for n in names]
    w = np.array([{"高": 1.0, "中": 0.68}.get(row[10], 0.35) for row in rows])
    return names, x, np.log([row[0] for row in rows]), w


def penalties(names, skill, pair, triple):
    return np.diag([{"intercept": 0, "skill": skill, "pair": pair, "triple": triple}.get(n.split(":", 1)[0], 2.5) for n in names])


def weighted(x, y, w, p, on):
    out = np.zeros(x.shape[1])
    out[on] = np.linalg.solve((x[:, on] * w[:, None]).T @ x[:, on] + p[np.ix_(on, on)], x[:, on].T @ (w * y))
    return out


@pytest.fixture(scope="module")
def rows():
    return drawn()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def spec(df):
    return models.salary_feature_spec(df)


def test_ridge_uses_the_bands(df, rows, spec):
    names, x, y, w = matrix(rows, spec)
    on = np.array([not n.startswith("triple:") for n in names])
    beta = sm.ridge_salary(df, spec)
    assert np.allclose(beta, weighted(x, y, w, penalties(names, 6, 14, 35), on), atol=1e-8)
    even = sm.ridge_salary(df.drop("confidence_band"), spec)
    assert np.allclose(even, weighted(x, y, np.ones(len(y)), penalties(names, 6, 14, 35), on), atol=1e-8) and np.abs(even - beta).max() > 1e-3


def test_signs_and_blend(df, rows, spec):
    names, x, y, w = matrix(rows, spec)
    beta = sm.ridge_salary(df, spec, "nonnegative")
    skills = np.array([n.split(":", 1)[0] in sm.SKILL_PARTS for n in names])
    gradient = (x * w[:, None]).T @ (x @ beta - y) + penalties(names, 6, 14, 35) @ beta
    free = ~np.array([n.startswith("triple:") for n in names]) & (~skills | (beta > 0))
    assert (beta[skills] >= 0).all() and np.abs(gradient[free]).max() < 1e-3
    base, full = sm.ridge_salary(df, spec, "none", False), sm.ridge_salary(df, spec, skill=8, pair=20)
    assert np.allclose(sm.ridge_salary(df, spec, blend=0.5), (base + full) / 2)


def test_robust_weights(df, rows, spec):
    names, x, y, w = matrix(rows, spec)
    on, p = np.array([not n.startswith("triple:") for n in names]), penalties(names, 6, 14, 35)
    r = np.abs(y - x @ weighted(x, y, w, p, on))
    cut = max(0.18, sorted(r)[len(r) // 2] * 1.4826 * 1.5)
    assert np.allclose(sm.robust_ridge(df, spec), weighted(x, y, w * np.minimum(1, cut / np.maximum(r, 1e-9)), p, on), atol=1e-8)


def plain_boost(x, y, w, features, rounds, least, rate=0.08):
    base = (w * y).sum() / w.sum()
    r, out = y - base, np.full(len(y), base)
    gain = lambda m: (w[m] * r[m]).sum() ** 2 / (w[m].sum() + 12)

    def grow(at, depth):
        value = (w[at] * r[at]).sum() / (w[at].sum() + 12)
        best, pick = 0.0, None
        if depth and at.sum() >= 2 * least:
            for j in features:
                yes, no = at & (x[:, j] > 0), at & (x[:, j] == 0)
                if min(yes.sum(), no.sum()) >= least and gain(yes) + gain(no) - gain(at) > best + 1e-10:
                    best, pick = gain(yes) + gain(no) - gain(at), j
        if pick is None:
            return np.where(at, value, 0.0), False
        return grow(at & (x[:, pick] > 0), depth - 1)[0] + grow(at & (x[:, pick] == 0), depth - 1)[0], True
    for _ in range(rounds):
        add, split = grow(np.ones(len(y), bool), 2)
        if not split:
            break
        r, out = r - rate * add, out + rate * add
    return out


def test_boosted_trees_equal_a_plain_loop(df, rows, spec):
    names, x, y, w = matrix(rows, spec)
    for skills in (True, False):
        model = sm.boosted_salary(df, spec, skills, rounds=6)
        features = [j for j, n in enumerate(names) if n != "intercept" and (skills or n.split(":", 1)[0] not in sm.SKILL_PARTS)]
        want = plain_boost(x, y, w, features, 6, max(18, int(len(rows) * 0.025)))
        got = df.withColumn("p", sm.predict_boosted(spec, model)).select("p").collect()
        assert np.allclose([r["p"] for r in got], want, atol=1e-9)


def test_gram_cells_of_folds(spark, df, rows):
    subsets = [sm.Subset("f", F.col("_fold") != 0, F.col("_fold") == 0), sm.Subset("all", F.lit(True), F.lit(False))]
    folded = sm.fold_rows(df, fold=F.when(F.col("city") == "a", 0).otherwise(1))
    sm.add_specs(folded, subsets)
    assert subsets[1].spec == models.salary_feature_spec(df) and subsets[0].spec == models.salary_feature_spec(df.filter("city <> 'a'"))
    systems = sm.gram_systems(sm.gram_cells(sm.design(folded, subsets)), subsets)
    for (gram, xy), part, s in zip(systems, ([r for r in rows if r[2] != "a"], rows), subsets):
        _, x, y, w = matrix(part, s.spec)
        assert np.allclose(gram, (x * w[:, None]).T @ x) and np.allclose(xy, x.T @ (w * y))


def test_selection(spark, df):
    light = [c for c in sm.CANDIDATES if c[0] in ("profile", "additive", "robust_three_way", "hybrid", "skill_boosted")]
    out = sm.salary_model_select(df, light, day="day")
    got = {r["candidate"]: r for r in out["metrics"].collect()}
    assert out["status"] == "ready" and set(got) == {n for n, _ in light} and all(r["rows"] == 400 for r in got.values())
    assert out["selected"] not in sm.BASELINES and got[out["selected"]]["mae_k"] < got["profile"]["mae_k"] and out["time_gate"] == "passed" and out["exploratory"]
    assert 0.1 < out["interval_log_half_width"] < 0.4 and len(out["model"]) == len(sm.feature_names(out["spec"]))
    none = sm.salary_model_select(spark.createDataFrame(drawn(seed=9, skill=0.0), SCHEMA), light, day="day")
    assert none["selected"] == "profile"
    assert sm.salary_model_select(df.limit(20), light)["status"] == sm.salary_model_select(df.limit(0), light)["status"] == "insufficient"


def test_increments(df):
    out = sm.skill_increments(df)
    gain = {r["name"]: r for r in out["effects"].collect()}
    assert out["published"] and out["baseline_skills"] == [] and gain["x"]["delta_k"] > 2 > gain["y"]["delta_k"] >= 0 and gain["x"]["n"] + gain["x"]["without_n"] == 400


def test_order_statistics(spark):
    draw = random.Random(8)
    data = [("a", draw.gauss(0, 1e6)) for _ in range(997)] + [("b", 5.0)] * 40 + [("c", v) for v in (1e-9, 2e-9, 1.0, 1e6, -1e7, 1e7)] + [("a", float("nan")), ("d", None)]
    frame = spark.createDataFrame(data, "g string, v double").repartition(3)
    groups = {g: sorted(v for h, v in data if h == g and v is not None and v == v) for g in "abcd"}
    ranks = [(g, k) for g, v in groups.items() for k in (0, len(v) // 3, len(v) // 2, len(v) - 1, len(v)) if k >= 0]
    got = {(r["g"], r["rank"]): r["value"] for r in stats.order_statistics(frame, "v", spark.createDataFrame(ranks, "g string, rank long"), ["g"], buckets=16).collect()}
    assert got == {(g, k): groups[g][k] for g, k in ranks if k < len(groups[g])}
    for p in (0.25, 0.5, 0.8):
        low = {r["g"]: r["value"] for r in stats.narrowed_quantile(frame.filter("g IN ('a', 'b')"), "v", p, ["g"]).collect()}
        assert low["b"] == 5.0 and abs(low["a"] - np.quantile(groups["a"], p)) < 1e-6
    assert stats.narrowed_quantile(frame.filter("g = 'b'"), "v", 0.5).first()["n"] == 40 and stats.narrowed_quantile(frame.filter("g = 'd'"), "v", 0.5).collect() == []
    copies = spark.createDataFrame([(1.0, 2), (3.0, 3), (9.0, 1)], "v double, n long")
    assert stats.narrowed_quantile(copies, "v", 0.4, copies="n").first()["value"] == 3.0


def test_frequent_sets_equal_every_combination(spark):
    import itertools
    from collections import Counter

    draw = random.Random(12)
    rows = [(float(draw.randint(5, 40)), [s for s in "abcdefg" if draw.random() < (0.8 if s in "ab" else 0.35)] * draw.choice([1, 2])) for _ in range(300)] + [(None, ["a", "b"])] * 20 + [(9.0, [])] * 10
    df = spark.createDataFrame(rows, "salary_midpoint_k double, skills array<string>")
    used = [(k, sorted(set(s))) for k, s in rows if k is not None]
    n, pays = Counter(), {}
    for k, s in used:
        for size in (2, 3, 4):
            for c in itertools.combinations(s, size):
                n[c] += 1
                pays.setdefault(c, []).append(k)
    single = Counter(x for _, s in used for x in s)
    lift = lambda c: n[c] / len(used) / max(math.prod(single[x] / len(used) for x in c), 1 / len(used))
    want = set()
    for size in (2, 3, 4):
        best = sorted((c for c in n if len(c) == size and n[c] >= max(5, math.ceil(len(used) * 0.03))), key=lambda c: (-n[c], -lift(c), c))[:12]
        want |= {(" + ".join(c), n[c], round(float(np.median(pays[c])), 1)) for c in best}
    assert {(r["name"], r["n"], r["raw_median_salary_k"]) for r in stats.frequent_sets(df).collect()} == want and len(want) == 36
    assert stats.frequent_sets(df.limit(0)).collect() == [] and stats.frequent_sets(df.filter("size(skills) = 0")).collect() == []
