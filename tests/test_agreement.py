"""Agreement statistics: published values, brute force, properties and edge cases."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from ratergrid.operators import agreement as A, alignment as L, reports as R
from ratergrid.operators.hygiene import dedupe_latest, latest_scores, melt_scores
from ratergrid.plans import REGISTRY, agreement as plans
from ratergrid.plans.studies import consistency_study, write_reports
from ratergrid.schemas import SCORE_COLS
from ratergrid.sources import scan_csv

# How often each pair of scores (first, second rating) occurs among 50 posts rated
# twice by one person, and the statistics published for them.
RETEST = {
    "V1": {(1, 1): 13, (1, 2): 1, (1, 3): 1, (2, 1): 5, (2, 2): 14, (2, 3): 3, (3, 2): 5, (3, 3): 8},
    "V2": {(1, 1): 45, (1, 2): 1, (2, 1): 4},
    "V3": {(1, 1): 48, (1, 2): 1, (2, 1): 1},
    "V4": {(1, 1): 50},
    "V5": {(1, 1): 26, (1, 2): 9, (2, 1): 5, (2, 2): 5, (2, 3): 1, (3, 1): 1, (3, 2): 3},
    "V6": {(1, 1): 24, (1, 2): 10, (2, 1): 7, (2, 2): 7, (3, 1): 1, (3, 3): 1},
    "V7": {(1, 1): 28, (1, 2): 14, (1, 3): 2, (2, 1): 4, (3, 2): 1, (3, 3): 1},
    "V8": {(1, 1): 18, (1, 2): 16, (1, 3): 2, (2, 1): 1, (2, 2): 9, (2, 3): 1, (3, 3): 3},
}
# variable: alpha, rho, p, MAD, mean drift, exact agreement
PUBLISHED = {
    "V1": (0.695, 0.700, 0.0000, 0.32, 0.08, 0.70),
    "V2": (-0.042, -0.042, 0.7715, 0.10, 0.06, 0.90),
    "V3": (-0.010, -0.020, 0.8881, 0.04, 0.00, 0.96),
    "V4": (None, None, None, 0.00, 0.00, 1.00),
    "V5": (0.355, 0.351, 0.0125, 0.40, 0.00, 0.62),
    "V6": (0.229, 0.224, 0.1180, 0.38, -0.02, 0.64),
    "V7": (-0.026, 0.033, 0.8215, 0.46, -0.26, 0.58),
    "V8": (0.321, 0.479, 0.0004, 0.44, -0.40, 0.60),
}
FLOOR = {"V2", "V3", "V4"}


def retest_rows():
    """One row per post: (id, V1..V8) of the first and of the second rating."""
    columns = {v: list(itertools.chain.from_iterable([pair] * n for pair, n in cells.items()))
               for v, cells in RETEST.items()}
    first = [(str(i), *[columns[v][i][0] for v in SCORE_COLS]) for i in range(50)]
    second = [(str(i), *[columns[v][i][1] for v in SCORE_COLS]) for i in range(50)]
    return first, second


def wide(spark, rows):
    return spark.createDataFrame(rows, "tweet_id string, " + ", ".join(f"{v} int" for v in SCORE_COLS))


def long_ratings(spark, rows):
    return spark.createDataFrame(rows, "unit_id string, rater string, variable string, score int")


def patterns_of(spark, rows, raters):
    return L.pattern_counts(L.score_grid(long_ratings(spark, rows), raters), raters)


def test_published_retest_values(spark):
    table = spark.createDataFrame(
        [("H1", "H2", v, a, b, n) for v, cells in RETEST.items() for (a, b), n in cells.items()],
        "rater_a string, rater_b string, variable string, a int, b int, n bigint")
    patterns = table.select("variable", F.col("a").alias("H1"), F.col("b").alias("H2"), "n")
    got = {r["variable"]: tuple(r)[1:] for r in R.intra_rater_table(patterns, "H1", "H2").collect()}
    assert got == PUBLISHED


def test_consistency_study_matches_published(spark, tmp_path):
    first, second = retest_rows()
    h1, h2 = wide(spark, first), wide(spark, second)
    models = (h1.withColumn("llm_name_version", F.lit("m-one"))
              .unionByName(h2.withColumn("llm_name_version", F.lit("m-two")))
              .unionByName(h2.withColumn("llm_name_version", F.lit("retired"))))
    out = consistency_study(h1, h2, models, {"m-one": "One", "m-two": "Two"},
                            short={"Human P1": "H1", "Human P2": "H2"}, legacy=["retired"])
    intra = {r["variable"]: tuple(r)[1:] for r in out["intra_annotator"].collect()}
    assert intra == PUBLISHED
    inter = out["inter_annotator"].orderBy("pair_ord", "variable").collect()
    assert len(inter) == 6 * 8
    assert [r["pairing"] for r in inter[::8]] == [
        "Human P1 vs Human P2", "Human P1 vs One", "Human P1 vs Two", "Human P2 vs One",
        "Human P2 vs Two", "One vs Two"]
    for r in inter[:8]:
        assert (r["spearman_rho"], r["spearman_p"], r["mad"]) == PUBLISHED[r["variable"]][1:4]
    alpha = {r["subset"]: r for r in out["krippendorff_alpha"].collect()}
    people = alpha["Humans only (H1, H2)"]
    assert [people[v] for v in SCORE_COLS] == [PUBLISHED[v][0] for v in SCORE_COLS]
    assert alpha["H1 + One"]["V1"] == 1.0
    assert set(alpha) == {"All annotators", "Humans only (H1, H2)", "LLMs only (2 models)", "H1 + One",
                          "H1 + Two", "H2 + One", "H2 + Two", "One + Two"}
    summary = {r["variable"]: r for r in out["reliability_summary"].collect()}
    assert {v for v, r in summary.items() if r["floor_effect"]} == FLOOR
    assert [summary[v]["alpha_humans"] for v in SCORE_COLS] == [PUBLISHED[v][0] for v in SCORE_COLS]
    counts = {r["variable"]: (r["n_up"], r["n_same"], r["n_down"]) for r in out["drift_counts"].collect()}
    assert counts["V8"] == (1, 30, 19)
    drift = out["score_drift"].collect()
    assert len(drift) == 50 and sum(r["V7_drift"] for r in drift) == -13
    stats = out["divergence_stats"].first()
    assert stats["n"] == 50
    assert out["divergence_hist"].count() == 9
    assert out["spread"].count() == 50
    assert out["score_distribution"].count() == 4 * 8 * 3
    write_reports(out, str(tmp_path))
    back = scan_csv(spark, f"{tmp_path}/intra_annotator", schema=out["intra_annotator"].schema)
    assert {r["variable"]: tuple(r)[1:] for r in back.collect()} == PUBLISHED
    drifts = scan_csv(spark, f"{tmp_path}/score_drift", schema="unit_id string, V1_H1 int, V1_H2 int, V1_drift int")
    assert drifts.count() == 50 and drifts.where("V1_drift != V1_H1 - V1_H2").count() == 0


def test_consistency_study_reads_text_scores_and_latest_rows(spark):
    """Scores as a CSV with blanks gives them, off-scale rows, and an older copy of each model row."""
    first, second = retest_rows()
    floats = wide(spark, first).select("tweet_id", *[F.format_string("%.1f", F.col(v).cast("double")).alias(v)
                                                     for v in SCORE_COLS])
    junk = spark.createDataFrame([("900", *["2.5"] * 8), ("901", *[None] * 8)],
                                 "tweet_id string, " + ", ".join(f"{v} string" for v in SCORE_COLS))
    h2 = wide(spark, second + [("900", *[1] * 8), ("901", *[1] * 8)])
    new = h2.withColumns({"llm_name_version": F.lit("m"), "at": F.lit(2)})
    old = wide(spark, [(r[0], *[3] * 8) for r in second]).withColumns({"llm_name_version": F.lit("m"), "at": F.lit(1)})
    out = consistency_study(floats.unionByName(junk), h2, new.unionByName(old), {"m": "M"}, order_cols=["at"])
    assert {r["variable"]: tuple(r)[1:] for r in out["intra_annotator"].collect()} == PUBLISHED
    retest = out["inter_annotator"].where("pairing = 'Human P2 vs M'").collect()
    assert all(r["mad"] == 0.0 for r in retest)


def brute_alpha(units):
    units = [u for u in units if len(u) >= 2]
    domain = sorted({v for u in units for v in u})
    if len(domain) < 2:
        return None
    o = {(c, k): 0.0 for c in domain for k in domain}
    for u in units:
        for i, c in enumerate(u):
            for j, k in enumerate(u):
                if i != j:
                    o[c, k] += 1.0 / (len(u) - 1)
    n = {c: sum(o[c, k] for k in domain) for c in domain}
    d = {(c, k): (sum(n[g] for g in domain if min(c, k) <= g <= max(c, k)) - (n[c] + n[k]) / 2) ** 2
         for c in domain for k in domain}
    seen = sum(o[c, k] * d[c, k] for c in domain for k in domain)
    expected = sum(n[c] * n[k] * d[c, k] for c in domain for k in domain if c != k)
    return 1 - (sum(n.values()) - 1) * seen / expected


def brute_rho(pairs):
    def ranks(xs):
        return [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]
    ra, rb = ranks([a for a, _ in pairs]), ranks([b for _, b in pairs])
    ma, mb = sum(ra) / len(ra), sum(rb) / len(rb)
    va, vb = sum((x - ma) ** 2 for x in ra), sum((x - mb) ** 2 for x in rb)
    if not va or not vb:
        return None
    return sum((x - ma) * (y - mb) for x, y in zip(ra, rb)) / math.sqrt(va * vb)


def random_ratings(seed, units=120, raters=("a", "b", "c", "d"), missing=0.3):
    rng = random.Random(seed)
    return [(str(u), r, v, rng.choice([1, 1, 2, 3])) for u in range(units) for r in raters
            for v in ("V1", "V2") if rng.random() > missing]


@pytest.mark.parametrize("seed", [1, 2])
def test_alpha_and_rho_match_brute_force(spark, seed):
    rows, raters = random_ratings(seed), ["a", "b", "c", "d"]
    by_profile = A.krippendorff_alpha(A.unit_profiles(long_ratings(spark, rows)))
    patterns = patterns_of(spark, rows, raters)
    by_pattern = A.alpha_by_subset(patterns, {"all": raters, "ab": ["a", "b"], "one": ["a"]})
    pairs = A.pair_metrics(A.contingency(patterns, L.rater_pairs(raters)))
    want = {}
    for v in ("V1", "V2"):
        units = {}
        for u, r, var, s in rows:
            if var == v:
                units.setdefault(u, {})[r] = s
        want[v] = units
    for r in by_profile.collect():
        assert r["alpha"] == pytest.approx(brute_alpha([list(u.values()) for u in want[r["variable"]].values()]))
    got = {(r["subset"], r["variable"]): r["alpha"] for r in by_pattern.collect()}
    assert {s for s, _ in got} == {"all", "ab"}
    for (s, v), alpha in got.items():
        members = raters if s == "all" else ["a", "b"]
        units = [[u[m] for m in members if m in u] for u in want[v].values()]
        assert alpha == pytest.approx(brute_alpha(units))
    for r in pairs.collect():
        both = [(u[r["rater_a"]], u[r["rater_b"]]) for u in want[r["variable"]].values()
                if r["rater_a"] in u and r["rater_b"] in u]
        assert r["n"] == len(both)
        assert r["rho"] == pytest.approx(brute_rho(both))
        assert r["mad"] == pytest.approx(sum(abs(a - b) for a, b in both) / len(both))
        assert r["msd"] == pytest.approx(sum(a - b for a, b in both) / len(both))
        assert r["alpha"] == pytest.approx(brute_alpha([list(p) for p in both]))


def test_identical_raters_agree_fully(spark):
    rows = [(str(u), r, "V1", 1 + u % 3) for u in range(30) for r in ("a", "b")]
    m = A.pair_metrics(A.contingency(patterns_of(spark, rows, ["a", "b"]), [("a", "b")])).first()
    assert (m["alpha"], m["rho"], m["mad"], m["pct_exact"]) == (1.0, 1.0, 0.0, 1.0)
    assert A.with_p_value(spark.createDataFrame([(1.0, 30)], "rho double, n long")).first()["p"] == 0.0


def test_undefined_statistics_are_null(spark):
    rows = [(str(u), "a", "V1", 1) for u in range(9)] + [(str(u), "b", "V1", 1 + u % 3) for u in range(9)]
    rows += [(str(u), r, "V2", 2) for u in range(9) for r in ("a", "b")]
    out = {r["variable"]: r for r in A.with_p_value(A.pair_metrics(
        A.contingency(patterns_of(spark, rows, ["a", "b"]), [("a", "b")]))).collect()}
    assert out["V1"]["rho"] is None and out["V1"]["p"] is None and out["V1"]["alpha"] is not None
    assert out["V2"]["rho"] is None and out["V2"]["alpha"] is None


def test_single_ratings_do_not_count(spark):
    rows = random_ratings(5)
    lone = rows + [(f"x{i}", "a", v, 3) for i in range(40) for v in ("V1", "V2")]
    alpha = lambda r: {x["variable"]: x["alpha"] for x in
                       A.krippendorff_alpha(A.unit_profiles(long_ratings(spark, r))).collect()}
    assert alpha(rows) == pytest.approx(alpha(lone))


def test_relabelling_raters_keeps_alpha(spark):
    rows = random_ratings(6)
    renamed = [(u, {"a": "z", "b": "a", "c": "b", "d": "c"}[r], v, s) for u, r, v, s in rows]
    one = A.krippendorff_alpha(A.unit_profiles(long_ratings(spark, rows))).orderBy("variable")
    two = A.krippendorff_alpha(A.unit_profiles(long_ratings(spark, renamed))).orderBy("variable")
    assert [r["alpha"] for r in one.collect()] == pytest.approx([r["alpha"] for r in two.collect()])


def test_swapping_raters(spark):
    rows = random_ratings(7, raters=("a", "b"), missing=0)
    patterns = patterns_of(spark, rows, ["a", "b"])
    one = A.pair_metrics(A.contingency(patterns, [("a", "b")])).orderBy("variable").collect()
    two = A.pair_metrics(A.contingency(patterns, [("b", "a")])).orderBy("variable").collect()
    for x, y in zip(one, two):
        assert x["rho"] == pytest.approx(y["rho"]) and x["alpha"] == pytest.approx(y["alpha"])
        assert x["mad"] == y["mad"] and x["msd"] == -y["msd"]


def test_a_unit_with_very_many_ratings(spark):
    """One unit holds a third of all ratings: the counts stay whole and match brute force."""
    rng = random.Random(3)
    rows = [(str(u), f"r{i}", "V1", rng.choice([1, 2, 3])) for u in range(100) for i in range(4)]
    rows += [("hot", f"r{i}", "V1", rng.choice([1, 2])) for i in range(200)]
    units = {}
    for u, _, _, s in rows:
        units.setdefault(u, []).append(s)
    got = A.krippendorff_alpha(A.unit_profiles(long_ratings(spark, rows))).first()
    assert got["n_ratings"] == 600
    assert got["alpha"] == pytest.approx(brute_alpha(list(units.values())))


def test_wide_and_long_paths_agree(spark):
    rows = random_ratings(8, missing=0)
    long = long_ratings(spark, rows)
    annotations = long.groupBy("unit_id", "rater").pivot("variable", ["V1", "V2"]).agg(F.first("score"))
    a = A.krippendorff_alpha(A.unit_profiles(melt_scores(annotations, ["V1", "V2"]))).orderBy("variable")
    b = A.krippendorff_alpha(A.unit_profiles_wide(annotations, ["V1", "V2"])).orderBy("variable")
    assert a.collect() == b.collect()
    raters = ["a", "b", "c", "d"]
    g1 = L.score_grid(long, raters).select("unit_id", "variable", *raters)
    g2 = L.score_grid_wide(annotations, raters, ["V1", "V2"])
    assert sorted(g1.collect()) == sorted(g2.collect())


def test_grid_with_more_scores_than_one_pack_holds(spark):
    """Forty variables on a 1-3 scale need two packed numbers."""
    cols = [f"Q{i}" for i in range(40)]
    rows = [(str(u), r, *[None if (u + i) % 7 == 0 else 1 + (u * 3 + i + len(r)) % 3 for i in range(40)])
            for u in range(5) for r in ("a", "bb")]
    df = spark.createDataFrame(rows, "unit_id string, rater string, " + ", ".join(f"{c} int" for c in cols))
    got = {(r["unit_id"], r["variable"]): (r["a"], r["bb"])
           for r in L.score_grid_wide(df, ["a", "bb"], cols).collect()}
    want = {}
    for u, r, *scores in rows:
        for c, s in zip(cols, scores):
            want.setdefault((u, c), {})[r] = s
    want = {k: (v["a"], v["bb"]) for k, v in want.items() if any(x is not None for x in v.values())}
    assert got == want
    stamped = df.withColumn("at", F.lit(1)).unionByName(
        df.withColumn("at", F.lit(0)).withColumns({c: F.lit(1) for c in cols}))
    latest = {(r["unit_id"], r["variable"]): (r["a"], r["bb"])
              for r in L.latest_score_grid(stamped, ["a", "bb"], ["at"], cols).collect()}
    assert latest == want


def test_empty_input(spark):
    empty = long_ratings(spark, [])
    assert A.krippendorff_alpha(A.unit_profiles(empty)).count() == 0
    patterns = L.pattern_counts(L.score_grid(empty, ["a", "b"]), ["a", "b"])
    assert A.pair_metrics(A.contingency(patterns, [("a", "b")])).count() == 0


def test_p_values_at_both_ends(spark):
    """Small samples against closed forms (df 1 and 2), huge ones against the normal tail."""
    rows = [(0.5, 3), (0.5, 4), (-0.5, 4), (1.96 / math.sqrt(4e6), 4_000_000)]
    got = [r["p"] for r in A.with_p_value(spark.createDataFrame(rows, "rho double, n long")).collect()]
    assert got[0] == pytest.approx(1 - 2 / math.pi * math.asin(0.5))
    assert got[1] == pytest.approx(0.5) and got[2] == pytest.approx(0.5)
    assert got[3] == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-6)


def test_consistency_study_follows_the_models_present(spark):
    first, second = retest_rows()
    h1, h2 = wide(spark, first), wide(spark, second[1:])
    models = (h1.withColumn("llm_name_version", F.lit("m-new"))
              .unionByName(h1.limit(40).withColumn("llm_name_version", F.lit("m-one")))
              .unionByName(h1.limit(1).withColumn("llm_name_version", F.lit(None).cast("string"))))
    out = consistency_study(h1, h2, models, {"m-gone": "Gone", "m-one": "One"}, cases=[second[5][0]])
    assert out["intra_annotator"].count() == 8
    assert [(r["rater"], r["n_rows"], r["n_models"]) for r in out["model_coverage"].orderBy("rater").collect()] == [
        ("One", 40, 2), ("m-new", 50, 2)]
    assert [r["unit_id"] for r in out["missing_ids"].collect()] == [str(second[0][0])]
    assert out["invalid_report"].count() == 0 and out["agreement_breakdown"].count() == 6 * 8
    assert out["cases"].count() <= 8
    with pytest.raises(ValueError, match="repeat"):
        consistency_study(h1.unionByName(h1.limit(1)), h2, models, {})
    with pytest.raises(ValueError, match="repeat"):
        consistency_study(h1, h2, models.unionByName(models.limit(1)), {})


def test_consistency_study_reports_invalid_rows(spark):
    first, second = retest_rows()
    bad = wide(spark, [(str(first[0][0]) + "x", *[9] * 8)])
    h1, h2 = wide(spark, first).unionByName(bad), wide(spark, second)
    out = consistency_study(h1, h2, h1.withColumn("llm_name_version", F.lit("m")), {})
    assert {(r["column"], r["n_invalid"]) for r in out["invalid_report"].collect()} == {("V1", 2)}
    assert out["invalid_rows"].count() == 2


def test_p_value_does_not_jump_where_the_formula_changes(spark):
    """Both formulas side by side at the switch, for t from near zero to far in the tail."""
    import numpy as np
    from ratergrid.functions.numeric import _t_tail_fraction, _t_tail_normal

    df, t = np.full(60, 1e6), np.linspace(0.001, 8, 60)
    exact, normal = _t_tail_fraction(df, df / (df + t ** 2)), _t_tail_normal(df, t)
    assert np.abs(exact - normal).max() < 1e-8
    assert np.allclose(exact, normal, rtol=1e-3, atol=1e-300)
    around = spark.createDataFrame([(0.002, n) for n in (999_999, 1_000_001, 1_000_002, 1_000_003, 1_000_010)], "rho double, n long")
    got = [r["p"] for r in A.with_p_value(around).orderBy("n").collect()]
    assert all(a > b and a - b < 1e-5 for a, b in zip(got, got[1:]))


def test_contingency_of_a_grid_equals_that_of_patterns(spark):
    rng = random.Random(3)
    raters = [f"r{i}" for i in range(6)]
    grid = spark.createDataFrame([(i, "V1", *[rng.choice([None, 1, 2, 3]) for _ in raters]) for i in range(200)],
                                 "unit_id long, variable string, " + ", ".join(f"{r} int" for r in raters))
    pairs = L.rater_pairs(raters)
    rows = lambda df: sorted(map(tuple, df.select("rater_a", "rater_b", "variable", "a", "b", "n").collect()))
    assert rows(A.contingency_of_grid(grid, pairs)) == rows(A.contingency(L.pattern_counts(grid, raters), pairs))


@pytest.mark.parametrize("most_bytes", [1, 64 << 20])
def test_dense_pair_counts_equal_those_of_a_grid(spark, most_bytes):
    """Missing and off-scale scores, several groups, NULL group values, and matrices handed on early."""
    rng = random.Random(6)
    raters = [f"r {i}" for i in range(6)]
    rows_in = [(i, rng.choice(["V1", "V2", None]), rng.randrange(3), *[rng.choice([1, 2, 3, None]) for _ in raters]) for i in range(400)]
    schema = "unit_id int, variable string, g int, " + ", ".join(f"`{r}` int" for r in raters)
    grid = spark.createDataFrame(rows_in, schema).repartition(3)
    rows = lambda df: {tuple(map(str, r)) for r in df.select("rater_a", "rater_b", "variable", "g", "a", "b", "n").collect()}
    want = rows(A.contingency_of_grid(grid, L.rater_pairs(raters), ["variable", "g"]))
    assert rows(A.contingency_dense(grid, raters, ["variable", "g"], most_bytes=most_bytes)) == want
    off = grid.withColumn("r 0", F.lit(9))
    assert A.contingency_dense(off, raters).where("rater_a = 'r 0'").count() == 0
    assert A.contingency_dense(grid, raters, []).groupBy("rater_a", "rater_b").count().count() == 15
    assert A.contingency_dense(grid.limit(0), raters).count() == 0


def test_a_study_counts_pairs_densely_with_the_same_tables(spark):
    rng = random.Random(9)
    rows_of = lambda: [(i, *[rng.choice([1, 2, 3]) for _ in SCORE_COLS]) for i in range(40)]
    make = lambda: spark.createDataFrame(rows_of(), "tweet_id long, " + ", ".join(f"{v} int" for v in SCORE_COLS))
    h1, h2 = make(), make()
    models = make().withColumn("llm_name_version", F.lit("a")).unionByName(make().withColumn("llm_name_version", F.lit("b")))
    sparse = consistency_study(h1, h2, models, {})
    dense = consistency_study(h1, h2, models, {}, dense_from=3)
    assert set(sparse) == set(dense)
    for name in sparse:
        rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
        assert dense[name].columns == sparse[name].columns, name
        for x, y in zip(rows(dense[name]), rows(sparse[name]), strict=True):
            assert all(a == (pytest.approx(b) if isinstance(b, float) else b) for a, b in zip(x, y)), name
    matrix = {(r["variable"], r["row"]): r for r in dense["agreement_matrix"].collect()}
    assert len(matrix) == 8 * 4 and matrix["V1", "a"]["a"] == 1.0 and matrix["V1", "a"]["b"] == matrix["V1", "b"]["a"]


@pytest.mark.parametrize("order", [["day"], ["flag", "small"], ["whole"], ["day", "small", "flag"]])
def test_packed_orders_choose_the_same_rows_as_structs(spark, order):
    """Negative numbers, early and late days and NULLs keep their places."""
    rng = random.Random(str(order))
    day = lambda: rng.choice([None, "0001-01-01", "1969-12-31", "1970-01-01", "2024-05-05", "9999-12-31"])
    rows_in = [(i % 25, rng.choice("abc"), day(), rng.choice([None, True, False]), rng.choice([None, -128, -1, 0, 5, 127]),
                rng.choice([None, -(2**31), -7, 0, 9, 2**31 - 1]), *[rng.choice([1, 2, 3, None]) for _ in range(3)]) for i in range(600)]
    df = spark.createDataFrame(rows_in, "unit_id int, rater string, day string, flag boolean, small tinyint, whole int, "
                                        "V1 int, V2 int, V3 int").withColumn("day", F.col("day").cast("date"))
    wide = df.withColumns({c: F.struct(c) for c in order})  # a struct never fits into a number
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    grids = [L.latest_score_grid(x, ["a", "b", "c"], order, ["V1", "V2", "V3"]) for x in (df, wide)]
    plans = [g._jdf.queryExecution().executedPlan().toString() for g in grids]
    assert "SortAggregate" not in plans[0] and "SortAggregate" in plans[1]
    assert rows(grids[0]) == rows(grids[1])


@pytest.mark.parametrize("name, profiles, per_row", [
    ("krippendorff_alpha_long", "unit_profiles", 4), ("krippendorff_alpha_ordinal", "unit_profiles_wide", 1)])
def test_alpha_counts_in_tasks_of_bounded_rows(spark, monkeypatch, name, profiles, per_row):
    """However few partitions shuffles have, no task counts more than about ``task_rows`` annotations."""
    made, sf = getattr(A, profiles), "/root/testdata/sf0.001"
    want = {r["variable"]: tuple(r) for r in REGISTRY[name].run(spark, sf).collect()}
    sizes = []

    def counted(rows, *args):
        sizes.extend(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())
        return made(rows, *args)

    monkeypatch.setattr(A, profiles, counted)
    monkeypatch.setattr(plans, "latest_scores", lambda *args: latest_scores(*args, task_rows=500), raising=False)
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r["variable"]: tuple(r) for r in REGISTRY[name].run(spark, sf).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
    assert got.keys() == want.keys() and all(got[v][:3] == want[v][:3] for v in want)
    assert [got[v][3] for v in sorted(got)] == pytest.approx([want[v][3] for v in sorted(want)], abs=1e-9)
    assert sum(sizes) > 4000 * per_row and max(sizes) < 750 * per_row


def test_latest_scores_deals_a_large_unit_out(spark):
    """One unit holds most ratings, each with copies; some keys hold NULLs."""
    rows = [("hot", f"r{i}", at, 1 + (i + at) % 3) for i in range(400) for at in range(3)]
    rows += [(None, "r1", at, 2) for at in range(700)] + [(f"u{i}", None, 1, 3) for i in range(30)]
    df = spark.createDataFrame(rows, "unit_id string, rater string, at int, V1 int")
    got = latest_scores(df, ["unit_id", "rater"], ["at"], ["V1"], task_rows=100)
    want = dedupe_latest(df, ["unit_id", "rater"], ["at"]).select("unit_id", "rater", "V1")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 431
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 100
    empty = latest_scores(df.limit(0), ["unit_id", "rater"], ["at"], ["V1"])
    assert empty.count() == 0 and empty.columns == ["unit_id", "rater", "V1"]
