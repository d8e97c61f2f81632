"""Salary models from sums by fold.

Postings of one fold with equal profile, label set and pay are folded into one row with a
weight. Specs, Gram matrices and residual sums of every training set (all folds but one, all
rows, the older rows) are sums over these rows, so all sets and candidates share each pass.
Only bounded sums reach the driver: about a hundred features, their products, and split sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.core import UNKNOWN, first_per_key, lookup, rnd, value
from hirelens.operators.sample import fnv_fold, time_holdout
from hirelens.operators.stats import K, narrowed_quantile, order_statistics
from hirelens.session import cut_lineage

#: Weights of the confidence bands of a match; any other band, and none, has the last one.
BANDS, OTHER_BAND = {"高": 1.0, "中": 0.68}, 0.35
#: Numbers of category values a model may use.
CATEGORIES = {"city": 8, "experience": 7, "education": 6, "company_size": 6, "employment_type": 10}
SKILL_PARTS = ("skill", "pair", "triple")


def band_weight(df: DataFrame, band: str = "confidence_band") -> Column:
    """The weight of a row by the confidence of its match; 1 for tables without such a column."""
    if band not in df.columns:
        return F.lit(1.0)
    weight = F.lit(OTHER_BAND)
    for name, amount in BANDS.items():
        weight = F.when(F.col(band) == name, F.lit(amount)).otherwise(weight)
    return weight


@dataclass
class Subset:
    """A training set and the rows it is tested on, as conditions over `_fold` and `_era`."""

    name: str
    fit: Column
    test: Column
    rows: int = 0
    spec: dict = field(default_factory=dict)


def fold_rows(df: DataFrame, labels: str = "skills", fold: Column | None = None, era: Column | None = None) -> DataFrame:
    """(_fold, _era, categories, _set, _y, _n, _w): equal rows in one. Stored."""
    used = [c for c in CATEGORIES if c in df.columns]
    keys = [(fold if fold is not None else F.lit(0)).alias("_fold"), (era if era is not None else F.lit("")).alias("_era"),
            *[F.coalesce(value(c), F.lit(UNKNOWN)).alias(c) for c in used], F.array_sort(F.array_distinct(F.coalesce(F.col(labels), F.array().cast("array<string>")))).alias("_set"), F.col(K).cast("double").alias("_y")]
    rows = df.select(*keys, band_weight(df).alias("_w"))
    return cut_lineage(rows.groupBy("_fold", "_era", *used, "_set", "_y").agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_w")))


def _per_subset(subsets: Sequence[Subset]) -> list[Column]:
    return [F.coalesce(F.sum(F.when(s.fit, F.col("_n"))), F.lit(0)).alias(f"_c{i}") for i, s in enumerate(subsets)]


def _top_names(counts: DataFrame, name: str, subsets: Sequence[Subset], allowed, least, most: int) -> dict[int, list]:
    """The `most` most frequent names of each subset that have `least` rows; ties by name."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.when(allowed(s) & (F.col(f"_c{i}") >= least(s.rows)), F.col(f"_c{i}")).alias("c")) for i, s in enumerate(subsets)])).alias("e")
    rows = counts.select(F.col(name).alias("name"), each).filter("e.c IS NOT NULL AND e.c > 0").select("name", "e.i", "e.c")
    out: dict[int, list] = {i: [] for i in range(len(subsets))}
    for r in first_per_key(rows, ["i"], [F.desc("c"), F.col("name")], most, "place").orderBy("i", "place").collect():
        out[r["i"]].append(r["name"])
    return out


def _count_rows(rows: DataFrame, subsets: Sequence[Subset]) -> None:
    for s, n in zip(subsets, rows.agg(*_per_subset(subsets)).first()):
        s.rows = n


def add_specs(rows: DataFrame, subsets: Sequence[Subset], most: tuple[int, int, int] = (26, 10, 8)) -> None:
    """J8 for all subsets at once: frequent skills, pairs and triples of them, and category values."""
    _count_rows(rows, subsets)
    sums = _per_subset(subsets)
    yes = lambda s: F.lit(True)
    skills = _top_names(rows.select(F.explode("_set").alias("s"), "_fold", "_era", "_n").groupBy("s").agg(*sums), "s", subsets, yes, lambda n: max(6, math.ceil(n * 0.03)), most[0])
    every = sorted({x for names in skills.values() for x in names})
    known = F.array(*[F.lit(x) for x in every]).cast("array<string>")
    held = cut_lineage(rows.select(F.array_sort(F.array_intersect("_set", known)).alias("p"), "_fold", "_era", "_n").groupBy("p", "_fold", "_era").agg(F.sum("_n").alias("_n")))
    two = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda b: F.array(a, b))))
    pairs = held.select(F.explode(two).alias("s"), "p", "_fold", "_era", "_n")
    triples = pairs.select(F.explode(F.filter("p", lambda t: t > F.element_at("s", -1))).alias("t"), "s", "_fold", "_era", "_n").withColumn("s", F.concat("s", F.array("t")))
    number = {s.name: i for i, s in enumerate(subsets)}
    inside = lambda s: F.size(F.array_except("s", F.array(*[F.lit(x) for x in skills[number[s.name]]]).cast("array<string>"))) == 0
    some = _top_names(pairs.groupBy("s").agg(*sums), "s", subsets, inside, lambda n: max(8, math.ceil(n * 0.05)), most[1])
    three = _top_names(triples.groupBy("s").agg(*sums), "s", subsets, inside, lambda n: max(10, math.ceil(n * 0.04)), most[2])
    used = [c for c in CATEGORIES if c in rows.columns]
    both = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in used])).alias("p"), "_fold", "_era", "_n")
    seen = cut_lineage(both.groupBy("p.c", "p.v").agg(*sums))
    values = {c: _top_names(seen.filter(F.col("c") == c), "v", subsets, yes, lambda n: 1, CATEGORIES[c]) for c in used}
    for i, s in enumerate(subsets):
        s.spec = {"skills": skills[i], "pairs": [" + ".join(x) for x in some[i]], "triples": [" + ".join(x) for x in three[i]], "categories": {c: values[c][i] for c in used}, "rows": s.rows}


def add_increment_specs(rows: DataFrame, subsets: Sequence[Subset]) -> None:
    """J13's specs for all subsets at once: up to 20 skills neither rare nor general, category values of ten rows, rarer ones pooled."""
    _count_rows(rows, subsets)
    sums = _per_subset(subsets)
    counts = rows.select(F.explode("_set").alias("s"), "_fold", "_era", "_n").groupBy("s").agg(*sums)
    number = {s.name: i for i, s in enumerate(subsets)}
    least = lambda n: max(10, math.ceil(n * 0.02))
    skills = _top_names(counts, "s", subsets, lambda s: F.col(f"_c{number[s.name]}") <= s.rows - least(s.rows), least, 20)
    used = [c for c in CATEGORIES if c in rows.columns]
    both = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in used])).alias("p"), "_fold", "_era", "_n")
    seen = cut_lineage(both.groupBy("p.c", "p.v").agg(*sums))
    kinds = {r["c"]: r for r in seen.groupBy("c").agg(*[F.count_if(F.col(f"_c{i}") > 0).alias(f"_c{i}") for i in range(len(subsets))]).collect()}
    values = {c: _top_names(seen.filter(F.col("c") == c), "v", subsets, lambda s: F.lit(True), lambda n: 10, 8) for c in used}
    for i, s in enumerate(subsets):
        cats = {c: ([None] if c in kinds and kinds[c][f"_c{i}"] > len(values[c][i]) else []) + values[c][i] for c in used}
        s.spec = {"skills": skills[i], "pairs": [], "triples": [], "categories": cats, "rows": s.rows}


def feature_names(spec: dict) -> list[str]:
    names = ["intercept"]
    for c, values in spec["categories"].items():
        names += [f"{c}:{v}" for v in values[1:]]
    return names + [f"skill:{s}" for s in spec["skills"]] + [f"pair:{p}" for p in spec["pairs"]] + [f"triple:{t}" for t in spec["triples"]]


def kinds(spec: dict) -> np.ndarray:
    first = [n.split(":", 1)[0] for n in feature_names(spec)]
    return np.array([k if k in (*SKILL_PARTS, "intercept") else "profile" for k in first])


def feature_columns(spec: dict, labels: str = "skills") -> Column:
    """Sorted indices of the features a row has."""
    flags = [F.lit(True)]
    for c, values in spec["categories"].items():
        flags += [F.coalesce(value(c), F.lit(UNKNOWN)) == v for v in values[1:]]
    has = lambda s: F.array_contains(labels, s)
    flags += [has(s) for s in spec["skills"]]
    for combo in spec["pairs"] + spec["triples"]:
        ok = F.lit(True)
        for s in combo.split(" + "):
            ok = ok & has(s)
        flags.append(ok)
    return F.array_compact(F.array(*[F.when(f, i) for i, f in enumerate(flags)]))


def design(rows: DataFrame, subsets: Sequence[Subset]) -> DataFrame:
    """(s, fit, x, y, group, n, w): the rows of every subset with the features of its spec, equal ones in one. Stored."""
    out = None
    group = F.col("employment_type") if "employment_type" in rows.columns else F.lit(UNKNOWN)
    for i, s in enumerate(subsets):
        one = rows.filter(s.fit | s.test).select(F.lit(i).alias("s"), s.fit.alias("fit"), feature_columns(s.spec, "_set").alias("x"), F.col("_y").alias("y"), group.alias("group"), F.col("_n").alias("n"), F.col("_w").alias("w"))
        out = one if out is None else out.unionByName(one)
    return cut_lineage(out.groupBy("s", "fit", "x", "y", "group").agg(F.sum("n").alias("n"), F.sum("w").alias("w")))


def gram_cells(rows: DataFrame, weight: Column | None = None, target: Column | None = None) -> DataFrame:
    """(s, i, j, w, n): sums over the fitted rows of a design; j = -1 holds the products with the target, i = j = -1 those of the target."""
    w = (weight if weight is not None else F.lit(1.0)) * F.col("w")
    y = target if target is not None else F.log("y")
    folded = rows.filter("fit").select("s", "x", w.alias("w"), (w * y).alias("wy"), (w * y * y).alias("wyy"), "n")
    folded = folded.groupBy("s", "x").agg(*[F.sum(c).alias(c) for c in ("w", "wy", "wyy", "n")])
    upper = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b >= a), lambda b: F.struct(a.alias("i"), b.alias("j"), F.col("w").alias("w"), F.col("n").alias("n")))))
    cross = F.transform("x", lambda a: F.struct(a.alias("i"), F.lit(-1).alias("j"), F.col("wy").alias("w"), F.col("n").alias("n")))
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.col("wyy").alias("w"), F.col("n").alias("n")))
    return folded.select("s", F.explode(F.concat(upper, cross, whole)).alias("c")).groupBy("s", "c.i", "c.j").agg(F.sum("c.w").alias("w"), F.sum("c.n").alias("n"))


def gram_systems(cells: DataFrame, subsets: Sequence[Subset]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gram matrix and target products of each subset."""
    out = [(np.zeros((len(feature_names(s.spec)),) * 2), np.zeros(len(feature_names(s.spec)))) for s in subsets]
    for r in cells.filter("i >= 0").collect():
        gram, xy = out[r["s"]]
        if r["j"] < 0:
            xy[r["i"]] = r["w"]
        else:
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["w"]
    return out


def solve(gram: np.ndarray, xy: np.ndarray, penalty: np.ndarray, active: np.ndarray, nonnegative: np.ndarray, rounds: int = 600, stop: float = 1e-7) -> np.ndarray:
    """Ridge coefficients of about a hundred features: a linear system, or coordinate descent where signs are bound."""
    beta, at = np.zeros(len(xy)), np.flatnonzero(active & ((np.diag(gram) + penalty) > 0))
    if not len(at):
        return beta
    system = gram[np.ix_(at, at)] + np.diag(penalty[at])
    beta[at] = np.linalg.lstsq(system, xy[at], rcond=None)[0]
    if not nonnegative[at].any():
        return beta
    beta[nonnegative] = np.maximum(0, beta[nonnegative])
    for _ in range(rounds):
        most = 0.0
        for i in at:
            new = (xy[i] - gram[i, at] @ beta[at] + gram[i, i] * beta[i]) / (gram[i, i] + penalty[i])
            new = max(0.0, new) if nonnegative[i] else new
            most, beta[i] = max(most, abs(new - beta[i])), new
        if most < stop:
            break
    return beta


def ridge(system: tuple[np.ndarray, np.ndarray], spec: dict, mode: str = "signed", pairs: bool = True, triples: bool = False, skill: float = 6, pair: float = 14, triple: float = 35) -> np.ndarray:
    """J9 from the sums: a penalty per group of features, signed or non-negative skills, or none of them."""
    kind = kinds(spec)
    on = {"skill": mode != "none", "pair": mode != "none" and pairs, "triple": mode != "none" and triples}
    penalty = np.array([{"intercept": 0, "profile": 2.5, "skill": skill, "pair": pair, "triple": triple}[k] for k in kind], float)
    return solve(*system, penalty, np.array([on.get(k, True) for k in kind]), (mode == "nonnegative") & np.isin(kind, SKILL_PARTS))


def _linear(betas: dict[int, np.ndarray]) -> Column:
    """x * beta, by subset."""
    def one(beta: np.ndarray) -> Column:
        coef = F.array(*[F.lit(float(b)) for b in beta])
        return F.aggregate("x", F.lit(0.0), lambda t, i: t + coef[i])

    out = F.lit(None).cast("double")
    for s, beta in betas.items():
        out = F.when(F.col("s") == s, one(beta)).otherwise(out)
    return out


def robust(rows: DataFrame, subsets: Sequence[Subset], first: dict[int, np.ndarray], **options) -> dict[int, np.ndarray]:
    """J10 for all subsets at once: weights min(1, cutoff / residual), the cutoff from the median residual of the first fit."""
    residual = F.abs(F.log("y") - _linear(first))
    seen = rows.filter("fit").select("s", residual.alias("r"), "n")
    ranks = seen.groupBy("s").agg(F.floor(F.sum("n") / 2).cast("long").alias("rank"))
    median = {r["s"]: r["value"] for r in order_statistics(seen, "r", ranks, ["s"], "n").collect()}
    cut = F.lit(None).cast("double")
    for s in first:
        cut = F.when(F.col("s") == s, F.lit(float(max(0.18, median.get(s, 0.0) * 1.4826 * 1.5)))).otherwise(cut)
    systems = gram_systems(gram_cells(rows, F.least(F.lit(1.0), cut / F.greatest(residual, F.lit(1e-9)))), subsets)
    return {s: ridge(systems[s], subsets[s].spec, **options) for s in first}


# --- J11: boosted trees of depth two over binary features ---------------------------------------------

SHRINK = 12.0


def _tree_values(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """Sum of the leaf values of all trees for the rows of a 0/1 matrix."""
    total = np.zeros(len(x))
    for tree in trees:
        at = x[:, tree["feature"]] > 0
        for side, mask in (("yes", at), ("no", ~at)):
            leaf = tree[side]
            if "feature" in leaf:
                total[mask] += np.where(x[mask, leaf["feature"]] > 0, leaf["yes"], leaf["no"])
            else:
                total[mask] += leaf["value"]
    return total


def _bits(lists: pa.Array, size: int) -> np.ndarray:
    ends = np.asarray(lists.offsets)
    out = np.zeros((len(lists), size), np.float32)
    out[np.repeat(np.arange(len(lists)), np.diff(ends)), np.asarray(lists.values)[ends[0]:ends[-1]]] = 1
    return out


def boost(rows: DataFrame, subsets: Sequence[Subset], with_skills: dict[str, bool], rounds: int = 45, rate: float = 0.08, leaf: float = 0.025, least: int = 18) -> dict[tuple[int, str], dict]:
    """J11 for all subsets and variants at once: (subset, variant) -> {base, rate, trees}.

    A row is its profile: sums of weight, weighted log pay and rows by profile are all that
    squared loss needs. Every level of a tree is one small job, in which tasks add up the
    residuals of their profiles by node and feature; the driver sees these sums only. A split
    needs `least` rows, or the share `leaf` of them, on both sides; a leaf is sum / (weight + 12).
    """
    profiles = rows.filter("fit").groupBy("s", "x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.log("y")).alias("wy"), F.sum("n").alias("n"))
    profiles = cut_lineage(profiles)
    sizes = [len(feature_names(s.spec)) for s in subsets]
    base = {r["s"]: (r["wy"] / r["w"] if r["w"] else 0.0) for r in profiles.groupBy("s").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy")).collect()}
    usable = {(s, v): np.flatnonzero((kinds(subsets[s].spec) != "intercept") & (skills | (kinds(subsets[s].spec) == "profile"))) for s in base for v, skills in with_skills.items()}
    models = {key: {"base": base[key[0]], "rate": rate, "trees": []} for key in usable}
    few = {key: max(least, int(subsets[key[0]].rows * leaf)) for key in usable}
    growing = set(models)

    def sums(roots: dict) -> dict:
        """{(s, variant, node): (w, r, n)} with one entry a feature and the total last; node 0 without, 1 with the root's feature."""
        state = {key: (models[key], roots.get(key)) for key in growing}

        def part(batches):
            total: dict = {}
            for batch in batches:
                which, w, wy, n = (np.asarray(batch.column(i)) for i in (0, 2, 3, 4))
                for s in np.unique(which):
                    mine = np.flatnonzero(which == s)
                    x = _bits(batch.column(1).take(pa.array(mine)), sizes[s])
                    full = np.hstack((x, np.ones((len(x), 1), np.float32)))
                    for (s2, v), (model, root) in state.items():
                        if s2 != s:
                            continue
                        r = wy[mine] - w[mine] * (model["base"] + model["rate"] * _tree_values(model["trees"], x))
                        per = np.stack((w[mine], r, n[mine].astype(float)), 1)
                        side = np.zeros(len(x), int) if root is None else x[:, root].astype(int)
                        for node in np.unique(side):
                            at = side == node
                            add = full[at].T.astype(float) @ per[at]
                            key = (int(s), v, int(node))
                            total[key] = total[key] + add if key in total else add
            rows = [(s, v, node, j, *line) for (s, v, node), table in total.items() for j, line in enumerate(table.tolist()) if line[2]]
            names = ("s", "v", "node", "j", "w", "r", "n")
            kinds_ = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds_)], list(names))

        out: dict = {}
        found = profiles.select("s", "x", "w", "wy", "n").mapInArrow(part, "s int, v string, node int, j int, w double, r double, n double").groupBy("s", "v", "node", "j").agg(*[F.sum(c).alias(c) for c in ("w", "r", "n")])
        for r in found.collect():
            out.setdefault((r["s"], r["v"], r["node"]), np.zeros((sizes[r["s"]] + 1, 3)))[r["j"]] = (r["w"], r["r"], r["n"])
        return out

    def split(key, table: np.ndarray | None) -> int | None:
        """The feature of the largest gain, the first of equal ones; None if no split is worth it."""
        if table is None or table[-1, 2] < 2 * few[key]:
            return None
        whole, best, feature = table[-1], 0.0, None
        for j in usable[key]:
            yes, no = table[j], whole - table[j]
            if yes[2] < few[key] or no[2] < few[key]:
                continue
            gain = yes[1] ** 2 / (yes[0] + SHRINK) + no[1] ** 2 / (no[0] + SHRINK) - whole[1] ** 2 / (whole[0] + SHRINK)
            if gain > best + 1e-10:
                best, feature = gain, int(j)
        return feature

    worth = lambda row: float(row[1] / (row[0] + SHRINK))
    for _ in range(rounds):
        top = sums({})
        roots = {key: split(key, top.get((*key, 0))) for key in growing}
        growing &= {key for key, root in roots.items() if root is not None}
        if not growing:
            break
        below = sums(roots)
        for key in growing:
            tree = {"feature": roots[key]}
            for node, side in ((1, "yes"), (0, "no")):
                table = below[(*key, node)]
                feature = split(key, table)
                tree[side] = {"value": worth(table[-1])} if feature is None else {"feature": feature, "yes": worth(table[feature]), "no": worth(table[-1] - table[feature])}
            models[key]["trees"].append(tree)
    return models


def predicted(rows: DataFrame, subsets: Sequence[Subset], linear: dict[str, dict[int, np.ndarray]], boosted: dict[tuple[int, str], dict], keep: Column | None = None) -> DataFrame:
    """(s, candidate, group, actual, predicted, residual, n): the tested rows under every model of their subset."""
    sizes = [len(feature_names(s.spec)) for s in subsets]

    def score(batches):
        for batch in batches:
            which = np.asarray(batch.column(0))
            for s in np.unique(which):
                mine = pa.array(np.flatnonzero(which == s))
                part = batch.take(mine)
                x = _bits(part.column(1), sizes[s])
                y = np.asarray(part.column(2))
                logs = {name: x @ betas[s] for name, betas in linear.items() if s in betas}
                logs |= {v: m["base"] + m["rate"] * _tree_values(m["trees"], x) for (s2, v), m in boosted.items() if s2 == s}
                for name, z in logs.items():
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([name] * len(y)), part.column(3), part.column(2), pa.array(np.exp(z)), pa.array(np.abs(np.log(y) - z)), part.column(4)], ["s", "candidate", "group", "actual", "predicted", "residual", "n"])

    tested = rows.filter(keep if keep is not None else ~F.col("fit")).select("s", "x", "y", "group", "n")
    return tested.mapInArrow(score, "s int, candidate string, group string, actual double, predicted double, residual double, n long")


def weighted_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """J14 for rows with a number of copies."""
    a, p, n = F.col("actual"), F.col("predicted"), F.col("n")
    mean = F.sum(n * a) / F.sum(n)
    g = df.groupBy(*by).agg(F.sum(n).alias("rows"), (F.sum(n * F.abs(a - p)) / F.sum(n)).alias("_mae"), (F.sum(n * F.abs(a - p) / F.greatest(a, F.lit(1.0))) / F.sum(n)).alias("_mape"),
                            F.sum(n * (a - p) * (a - p)).alias("_sse"), (F.sum(n * a * a) - F.sum(n) * mean * mean).alias("_sst"))
    return g.select(*by, "rows", rnd("_mae", 3).alias("mae_k"), rnd("_mape", 3).alias("mape"), rnd(1 - F.col("_sse") / F.greatest("_sst", F.lit(1e-9)), 3).alias("r2"))


# --- single fits, selection and increments -------------------------------------------------------------

# The ten salary model candidates.
CANDIDATES = [
    ("profile", {"mode": "none", "pairs": False}), ("additive", {"mode": "signed", "pairs": False, "skill": 8}), ("interaction", {"mode": "signed", "skill": 8, "pair": 20}),
    ("interaction_shrunk", {"mode": "signed", "skill": 18, "pair": 40}), ("three_way", {"mode": "signed", "triples": True, "skill": 18, "pair": 40, "triple": 60}),
    ("robust_three_way", {"mode": "signed", "triples": True, "skill": 18, "pair": 40, "triple": 60, "robust": True}), ("monotone", {"mode": "nonnegative"}),
    ("hybrid", {"blend": 0.5}), ("profile_boosted", {"boosted": False}), ("skill_boosted", {"boosted": True})]
BASELINES = ("profile", "profile_boosted")


def _whole(df: DataFrame, spec: dict, labels: str) -> tuple[DataFrame, list[Subset]]:
    one = Subset("all", F.lit(True), F.lit(False), spec=spec)
    rows = fold_rows(df, labels)
    _count_rows(rows, [one])
    return design(rows, [one]), [one]


def _blended(system, spec: dict, share: float) -> np.ndarray:
    return ridge(system, spec, **dict(CANDIDATES)["profile"]) * (1 - share) + ridge(system, spec, **dict(CANDIDATES)["interaction"]) * share


def ridge_salary(df: DataFrame, spec: dict, mode: str = "signed", pairs: bool = True, triples: bool = False, skill: float = 6, pair: float = 14, triple: float = 35, blend: float | None = None, labels: str = "skills") -> np.ndarray:
    """Ridge on log salary, weighted by confidence band, a penalty per feature group; `blend` mixes the baseline with the interaction model."""
    rows, one = _whole(df, spec, labels)
    system = gram_systems(gram_cells(rows), one)[0]
    return _blended(system, spec, blend) if blend is not None else ridge(system, spec, mode, pairs, triples, skill, pair, triple)


def robust_ridge(df: DataFrame, spec: dict, labels: str = "skills", **options) -> np.ndarray:
    """A second fit whose weights shrink with the residuals of the first."""
    rows, one = _whole(df, spec, labels)
    first = ridge(gram_systems(gram_cells(rows), one)[0], spec, **options)
    return robust(rows, one, {0: first}, **options)[0]


def boosted_salary(df: DataFrame, spec: dict, with_skills: bool = True, labels: str = "skills", **options) -> dict:
    """Boosted trees of depth two on the same features, weighted by confidence band."""
    rows, one = _whole(df, spec, labels)
    return boost(rows, one, {"one": with_skills}, **options)[0, "one"]


def predict_log(spec: dict, beta: np.ndarray, labels: str = "skills") -> Column:
    """Linear prediction as a column: the coefficient list is a literal array."""
    coef = F.array(*[F.lit(float(b)) for b in beta])
    return F.aggregate(feature_columns(spec, labels), F.lit(0.0), lambda s, i: s + coef[i])


def predict_boosted(spec: dict, model: dict, labels: str = "skills") -> Column:
    """Prediction of boosted trees as a column."""
    def tree(t: dict, x: Column) -> Column:
        side = lambda leaf: F.when(F.array_contains(x, leaf["feature"]), leaf["yes"]).otherwise(leaf["no"]) if "feature" in leaf else F.lit(leaf["value"])
        return F.when(F.array_contains(x, t["feature"]), side(t["yes"])).otherwise(side(t["no"]))

    # Bound once: every tree reads the same list of features.
    total = lambda x: sum((tree(t, x) * model["rate"] for t in model["trees"]), F.lit(float(model["base"])))
    return F.transform(F.array(feature_columns(spec, labels)), total)[0]


def salary_model_select(df: DataFrame, candidates: Sequence[tuple[str, dict]] = CANDIDATES, day: str | None = None, company: str = "company_name", least: int = 40, labels: str = "skills", relevance: float = 1.0) -> dict:
    """Candidates compared by company-grouped folds; a skill model must beat the baseline by max(0.2, 5%),
    and must not lose on the newest 20% of dated rows.

    Returns the choice, metrics by candidate and by employment type, the residual interval, reliability, the
    errors on the newer rows, whether the best skill model may be shown as an exploration (both gains at least
    0.1), and the chosen model fitted on all rows. Folds, the older rows and all rows are fitted side by side.
    """
    rows = df.filter((F.col(K) >= 3) & (F.col(K) <= 200))
    key = fnv_fold(F.coalesce(value(company), F.lit("?")), 1 << 31) if company in df.columns else F.lit(0)
    if day:
        rows = time_holdout(rows, day)
    folded = fold_rows(rows, labels, key, F.coalesce(F.col("part"), F.lit("")) if day else None)
    n = folded.agg(F.sum("_n")).first()[0] or 0
    if n < least:
        return {"status": "insufficient", "sample_count": n}
    folds = min(5, max(3, n // 30))
    folded = folded.withColumn("_fold", (F.col("_fold") % folds).cast("int"))
    sizes = {(r["_fold"], r["_era"]): r["n"] for r in folded.groupBy("_fold", "_era").agg(F.sum("_n").alias("n")).collect()}
    held = sorted({f for f, _ in sizes if sum(c for (g, _), c in sizes.items() if g != f)})
    old, new = (sum(c for (_, e), c in sizes.items() if e == name) for name in ("train", "holdout"))
    subsets = [Subset(f"fold {f}", F.col("_fold") != f, F.col("_fold") == f) for f in held] + [Subset("all", F.lit(True), F.lit(False))]
    if old >= 60 and new >= 20:
        subsets.append(Subset("older", F.col("_era") == "train", F.col("_era") == "holdout"))
    add_specs(folded, subsets)
    table = design(folded, subsets)
    systems, options = gram_systems(gram_cells(table), subsets), dict(candidates)
    number = range(len(subsets))
    linear: dict[str, dict[int, np.ndarray]] = {}
    for name, o in options.items():
        if "boosted" in o:
            continue
        plain = {k: v for k, v in o.items() if k not in ("robust", "blend")}
        linear[name] = {i: _blended(systems[i], subsets[i].spec, o["blend"]) if "blend" in o else ridge(systems[i], subsets[i].spec, **plain) for i in number}
        if o.get("robust"):
            linear[name] = robust(table, subsets, linear[name], **plain)
    trees = boost(table, subsets, {name: o["boosted"] for name, o in options.items() if "boosted" in o}) if any("boosted" in o for o in options.values()) else {}
    scored = cut_lineage(predicted(table, subsets, linear, trees))
    cv, newer = scored.filter(F.col("s") < len(held)), scored.filter(F.col("s") == len(held) + 1)
    mean = F.sum(F.col("n") * F.abs(F.col("actual") - F.col("predicted"))) / F.sum("n")
    errors = lambda d: {r["candidate"]: r["m"] for r in d.groupBy("candidate").agg(mean.alias("m")).collect()}
    raw, late = errors(cv), errors(newer)
    base = min((c for c in raw if c in BASELINES), key=raw.get)
    skill = min((c for c in raw if c not in BASELINES), key=raw.get, default=base)
    chosen = skill if raw[skill] <= raw[base] - max(0.2, raw[base] * 0.05) else base
    gate = "not evaluated"
    if late and chosen != base:
        gate = "passed" if round(late[chosen], 3) <= round(late[base], 3) else "withdrawn"
        chosen = chosen if gate == "passed" else base
    picked = cv.filter(F.col("candidate") == chosen)
    m = weighted_metrics(picked).first()
    width = narrowed_quantile(picked, "residual", 0.8, copies="n").first()["value"]
    level = ("中等" if chosen not in BASELINES and n >= 150 and m["mape"] <= 0.3 and m["r2"] >= 0.4 and relevance >= 0.5 else "谨慎参考" if n >= 80 and m["mape"] <= 0.45 and m["r2"] >= 0.1 else "低")
    whole = len(held)
    model = linear[chosen][whole] if chosen in linear else trees[whole, chosen]
    explore = bool(late) and skill != base and raw[base] - raw[skill] >= 0.1 and late[base] - late[skill] >= 0.1
    return {"status": "ready", "sample_count": n, "selected": chosen, "baseline": base, "time_gate": gate, "time_mae_k": late, "metrics": weighted_metrics(cv, ["candidate"]),
            "by_employment": weighted_metrics(picked, ["group"]).withColumnRenamed("group", "employment_type"), "interval_log_half_width": width, "reliability": level, "folds": folds,
            "exploratory": skill if explore else None, "spec": subsets[whole].spec, "model": model}


def skill_increments(df: DataFrame, labels: str = "skills", penalties: Sequence[float] = (2, 10, 40), folds: int = 3, company: str = "company_key") -> dict:
    """Non-negative additive increments in thousands a month over a supported base skill set; folds and penalties share one pass of sums."""
    rows = df.filter((F.col(K) >= 3) & (F.col(K) <= 200))
    if "job_id" in df.columns:
        rows = first_per_key(rows, ["platform", "job_id"], [F.col("seq")])
    folded = fold_rows(rows.drop("confidence_band"), labels, fnv_fold(company, folds))
    n = folded.agg(F.sum("_n")).first()[0] or 0
    per = {r["_fold"]: r["n"] for r in folded.groupBy("_fold").agg(F.sum("_n").alias("n")).collect()}
    held = [f for f in sorted(per) if n - per[f] >= 40]
    subsets = [Subset(f"fold {f}", F.col("_fold") != f, F.col("_fold") == f) for f in held] + [Subset("all", F.lit(True), F.lit(False))]
    add_increment_specs(folded, subsets)
    spec = subsets[-1].spec
    if n < 80 or not spec["skills"] or not held:
        return {"status": "insufficient", "sample_count": n}
    table = design(folded, subsets)
    systems = gram_systems(gram_cells(table, target=F.col("y")), subsets)

    def fit(i: int, penalty: float, skills: bool = True) -> np.ndarray:
        kind = kinds(subsets[i].spec)
        pen = np.array([{"intercept": 0, "profile": 2}.get(k, penalty) for k in kind], float)
        return solve(*systems[i], pen, np.array([skills or k != "skill" for k in kind]), kind == "skill", 500, 1e-6)

    betas = {"baseline": {i: fit(i, 10, False) for i in range(len(held))}} | {str(p): {i: fit(i, p) for i in range(len(held))} for p in penalties}
    # Pay itself is the target here, so the linear sums are the predictions.
    scored = cut_lineage(predicted(table, subsets, betas, {}).withColumn("predicted", F.log("predicted")))
    error = F.sum(F.col("n") * F.abs(F.col("actual") - F.col("predicted"))) / F.sum("n")
    mae = {r["candidate"]: r["m"] for r in scored.groupBy("candidate").agg(error.alias("m")).collect()}
    best = min((str(p) for p in penalties), key=mae.get)
    beta = fit(len(held), float(best))
    baskets = folded.groupBy(F.col("_set").alias("b")).agg(F.sum("_n").alias("c")).filter(F.col("c") >= max(5, math.ceil(n * 0.01)))
    first = baskets.orderBy(F.size("b"), F.col("c").desc(), "b").limit(1).collect()
    if not first:
        return {"status": "insufficient", "sample_count": n}
    foundation = first[0]["b"]
    fixed = folded.withColumn("_base", F.array(*[F.lit(s) for s in foundation]).cast("array<string>"))
    baseline = fixed.agg((F.sum(F.col("_n") * predict_log(spec, beta, "_base")) / F.sum("_n")).alias("b")).first()["b"]
    gain = mae["baseline"] - mae[best]
    publish = gain >= max(0.1, mae["baseline"] * 0.02) and baseline > 0
    names = feature_names(spec)
    counts = folded.select(F.explode("_set").alias("name"), "_n").groupBy("name").agg(F.sum("_n").alias("n"))
    deltas = [(s, 0.0 if s in foundation else float(beta[names.index(f"skill:{s}")]), s in foundation) for s in spec["skills"]]
    joined = counts.join(lookup(df.sparkSession, deltas, "name string, _d double, foundation boolean"), "name")
    effects = joined.select("name", "n", (n - F.col("n")).alias("without_n"), "foundation", F.when(F.lit(publish), F.col("_d")).alias("delta_k"), F.when(F.lit(publish), F.col("_d") / baseline * 100).alias("delta_pct"))
    metrics = weighted_metrics(scored, ["candidate"]).withColumnRenamed("candidate", "penalty")
    return {"status": "ready", "sample_count": n, "penalty": float(best), "baseline_skills": foundation, "baseline_salary_k": baseline, "published": publish, "validation_gain_k": gain, "effects": effects, "metrics": metrics}
