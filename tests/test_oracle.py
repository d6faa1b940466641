"""Every registered query with SQL: the same rows as DuckDB gives on the same tables."""

import datetime
import math

import duckdb
import pytest

from panelforge.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(found):
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=2.1e-6, rel_tol=1e-9)


def compare(spark, sf, name):
    got = QUERIES[name](spark, sf)
    want = connect(sf).sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = rows(got.select(columns).collect()), rows(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert len(a) == len(b), (len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b) if not all(map(same, x, y))]
    assert not wrong, (columns, len(wrong), wrong[:3])
    return len(a)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, name):
    # what asks for long histories has rows at the next size
    assert compare(spark, sf, name) > 0 or compare(spark, "/root/testdata/sf0.01", name) > 0 or name in EMPTY


#: Reports of what is wrong, where nothing is at this size.
EMPTY = {"e12_filter_significant", "g05_find_pairs", "k04_approval_log_violations"}


def close(a, b, by=2e-5):
    return a is None or b is None or math.isclose(a, b, rel_tol=1e-4, abs_tol=by)


def step_up(rows):
    """Which p the step-up rule rejects at 0.1, in plain Python."""
    known = sorted((r["p"], r["signal"]) for r in rows)
    last = max((i for i, (p, _) in enumerate(known, 1) if p <= 0.1 * i / len(known)), default=0)
    return {s for _, s in known[:last]}


def fits(rows):
    return {r["role"] for r in rows} == {"train", "test"} and all(r["r2"] <= 1 and abs(r["ic"]) <= 1 and r["n"] > 0 for r in rows)


def balanced(rows):
    w = [r["weight"] for r in rows]
    return sum(map(abs, w)) <= 2 + 1e-4 and max(map(abs, w)) <= 0.02 + 1e-6 and abs(sum(w)) < 1e-4


def transitions(rows):
    out: dict = {}
    for r in rows:
        out[r["from_label"]] = out.get(r["from_label"], 0) + r["p"]
    return all(close(v, 1) for v in out.values())


#: What the rows of queries without SQL must be like; the operators' own tests hold them against plain Python.
RULES = {
    "b08_technical_features_all": lambda x: len({(r["ticker"], r["feature"]) for r in x}) == len(x) if "feature" in x[0] else len({r["ticker"] for r in x}) == len(x),
    "d09_select_features": lambda x: 0 < sum(r["kept"] for r in x) <= 2 and all(r["kept"] == (r["reason"] == "kept") for r in x),
    "e08_score_signals_fdr": lambda x: {r["signal"] for r in x if r["passed"]} == step_up(x),
    "e19_expression_search": lambda x: all(close(r["fitness"], abs(r["ic"]) - 0.001 * r["size"]) for r in x) and len({r["expression"] for r in x}) == len(x) <= 10,
    "e20_parameter_search": lambda x: len(x) == 1 and all(-1 <= x[0][w] <= 1 for w in ("w1", "w2", "w3")),
    "f02_gbt_alpha": fits,
    "f03_rf_alpha": lambda x: all(0 <= r["accuracy"] <= 1 and abs(r["mean_score"]) <= 0.5 for r in x),
    "f04_linear_alpha": fits,
    "f14_perturbed_features": lambda x: len(x) == 1 and x[0]["n"] > 0 and all(x[0][c] > 0 for c in ("mom", "rev", "vol")),
    "f15_regime_clusters": lambda x: all(close(r["p0"] + r["p1"], 1) and r["label"] == int(r["p1"] > r["p0"]) for r in x if abs(r["p0"] - r["p1"]) > 1e-5),
    "f15_regime_transitions": transitions,
    # what is lost is what the components do not explain, once samples' and populations' deviations are told apart
    "f19_feature_compression": lambda x: close(x[0]["error"], (1 - x[0]["explained"]) * (x[0]["n"] - 1) / x[0]["n"]),
    "f20_correlation_embedding": lambda x: len({r["ticker"] for r in x}) == len(x) > 2,
    "f20_similar_assets": lambda x: all(abs(r["similarity"]) <= 1 and r["ticker"] != r["other"] and 1 <= r["rank"] <= 10 for r in x) and len({(r["ticker"], r["rank"]) for r in x}) == len(x),
    "g07_kalman_pair_signal": lambda x: {r["signal"] for r in x} <= {-1, 0, 1} and len({(r["a"], r["b"], r["date"]) for r in x}) == len(x),
    "g08_pair_signals_as_of": lambda x: all(r["signal"] in (-1, 1) and str(r["date"]) < "1998" or r["signal"] for r in x) and len({(r["a"], r["b"]) for r in x}) == len(x),
    "h11_mean_variance_weights": balanced,
    "i15_deflated_sharpe": lambda x: all(0 <= r["dsr"] <= 1 and r["expected_max"] > 0 for r in x),
    "i19_research_cycle": lambda x: {"mom", "rev", "vol", "combined"} == {r["signal"] for r in x},
}


def test_every_query_is_held_against_something():
    assert set(QUERIES) == set(ORACLE_SQL) | set(RULES)


@pytest.mark.parametrize("name", sorted(RULES))
def test_by_rule(spark, sf, name):
    for d in (sf, "/root/testdata/sf0.01"):  # what asks for long histories has rows at the next size
        found = [r.asDict() for r in QUERIES[name](spark, d).collect()]
        if found and found[0].get("n_folds") != 0:
            break
    assert found and RULES[name](found), found[:5]
