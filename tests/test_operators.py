"""Operators on small cases that the driver tables don't hold."""

import hashlib
import json
import math
import random
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.functions.ontology import Label, Ontology
from sieveline.operators import annotation as A
from sieveline.operators import duplicates as D
from sieveline.operators import evaluation as E
from sieveline.operators import inference as I
from sieveline.operators import joins as J
from sieveline.operators import records as R
from sieveline.operators import sampling as S
from sieveline.operators import validation as V
from sieveline.operators.components import connected_components
from sieveline.operators.evidence import source_votes
from sieveline.plans import provenance as P
from sieveline.plans.membership import maybe_in
from sieveline.sources import config, images, recipes, tables
from sieveline.streaming import incremental
from sieveline.streaming.store import BucketedStore

FOOD = Ontology(
    (
        Label("rice", "staple", ("nasi",)), Label("noodles", "staple", ("mi", "noodle")), Label("egg"), Label("tofu"), Label("fried_shallot", aliases=("fried shallots",)),
        Label("peanut"), Label("peanut_sauce", aliases=("saus kacang",)), Label("coconut_sauce", aliases=("coconut milk sauce", "coconut milk")),
    ),
    "v1",
)


def one(spark, expr, **values):
    names = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).select(*[c.alias(k) for k, c in names.items()]).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Nasi with coconut milk sauce and fried shallots", ["rice", "fried_shallot", "coconut_sauce"]),
        ("fresh chopped large", []), ("rice egg,tofu;mi", ["rice", "noodles", "egg", "tofu"]), ("peanut sauce/peanut", ["peanut", "peanut_sauce"]), ("riceé", ["rice"]), ("riceb", []), ("RICE_egg-tofu", ["rice", "egg", "tofu"]), (None, []),
        ("saus kacang", ["peanut_sauce"]),
    ],
)
def test_extract(spark, text, want):
    assert one(spark, FOOD.extract(F.col("t").cast("string")), t=text) == want


def test_full_width_needs_normalising(spark):
    assert one(spark, FOOD.extract(T.normalize(F.col("t"))), t="ＲＩＣＥ") == ["rice"]
    assert one(spark, FOOD.of_items(F.col("t")), t=["coconut", "milk sauce"]) == []


def test_ontology_is_checked_and_cells_round(spark, tmp_path):
    with pytest.raises(ValueError, match="repeat"):
        Ontology((Label("a"), Label("a")))
    with pytest.raises(ValueError, match="several"):
        Ontology((Label("a", aliases=("x",)), Label("b", aliases=("X",))))
    cell = one(spark, FOOD.parse_cell(F.col("t")), t=" Egg| nasi ,blue;egg ")
    assert (cell["labels"], cell["unknown"]) == (["rice", "egg"], ["blue"])
    assert one(spark, FOOD.parse_cell(F.col("t")), t="NaN")["labels"] == []
    assert one(spark, FOOD.serialize(F.col("t")), t=["tofu", "rice"]) == "rice|tofu"
    with pytest.raises(Exception, match="unknown labels"):
        one(spark, FOOD.serialize(F.col("t")), t=["blue"])
    path = tmp_path / "o.json"
    path.write_text(json.dumps({"version": "v1", "scope": "", "labels": [{"id": x.id, "category": x.category, "aliases": x.aliases, "hint": x.hint} for x in FOOD.labels]}))
    assert Ontology.read(str(path)) == FOOD
    rows = FOOD.cells(spark.createDataFrame([("s", ["egg"])], "sample_id string, l array<string>"), "l").collect()
    assert [r["y"] for r in rows] == [0, 0, 1, 0, 0, 0, 0, 0] and "rice" in FOOD.prompt("Name it.") and FOOD.table(spark).count() == 8


def test_scalars(spark):
    assert [one(spark, T.parse_boolean(F.col("t")), t=t) for t in ("YES", "0", "", "maybe")] == [True, False, False, None]
    for url, want in (("http://www.m.x.com/a", "m.x.com"), ("https://M.X.com:80/", "x.com"), ("http://u@amp.y.org", "y.org"), ("", ""), ("nonsense", "")):
        assert one(spark, T.domain(F.col("t")), t=url) == want
    assert one(spark, T.hamming(T.hash_bits(F.col("a")), T.hash_bits(F.col("b"))), a="ffffffffffffffff", b="8000000000000000") == 63
    assert one(spark, T.loss_mask(F.col("i"), F.col("a"), F.lit(2)), i=[10, 11, 20, 21, 0, 5], a=[1, 1, 1, 1, 1, 0]) == [-100, -100, 20, 21, 0, -100]
    assert one(spark, T.loss_mask(F.col("i"), F.col("a"), F.lit(0)), i=[1], a=[2]) is None
    assert one(spark, T.slug(F.col("t"), F.col("f")), t=" ", f="My_Dish 1.jpg") == "my-dish-1-jpg" and one(spark, T.slug(F.col("t"), F.col("f")), t="!!", f="A_b") == "a b"
    assert T.column_slug("CNN - A") == "cnn___a"


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1030)] + [(5000, i) for i in range(2000, 2100)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long")).collect()
    assert {g.node: g.component for g in got} == {x: root(x) for x in parent} and len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_membership_drops_no_partner(spark):
    a, b = spark.range(1000), spark.range(0, 1000, 37).withColumnRenamed("id", "w")
    kept = {r.id for r in maybe_in(a, "id", b, "w").collect()}
    assert set(range(0, 1000, 37)) <= kept and len(kept) < 60


def inv(spark, rows):
    return spark.createDataFrame(rows, "relative_path string, food_class string, status string, sha256 string, dhash string")


def test_duplicate_groups(spark):
    chain = [("a", "x", "ok", "a" * 64, "0000000000000000"), ("b", "x", "ok", "b" * 64, "0000000000000003"), ("c", "y", "ok", "c" * 64, "000000000000000f"), ("d", "y", "ok", "d" * 64, "ffffffffffffffff"),
             ("e", "z", "ok", "d" * 64, "ffffffffffffffff"), ("f", "z", "corrupt", "", ""), ("g", "z", "ok", "e" * 64, "7fffffffffffffff")]
    got = {r.relative_path: (r.duplicate_group, r.duplicate_group_size) for r in D.duplicate_groups(inv(spark, chain)).collect()}
    assert got["a"] == got["b"] == got["c"] == ("dup-" + "a" * 16, 3) and got["d"] == got["e"] == got["g"] == ("dup-" + "d" * 16, 3) and got["f"] == ("", 0)
    exact = {r.relative_path: r.duplicate_group_size for r in D.duplicate_groups(inv(spark, chain), -1).collect()}
    assert exact == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 2, "f": 0, "g": 1}
    with pytest.raises(ValueError):
        D.duplicate_groups(inv(spark, chain), 3)
    firsts = D.representatives(D.duplicate_groups(inv(spark, chain)).where("status = 'ok'")).collect()
    assert {(r.relative_path, r.food_class) for r in firsts} == {("a", "x"), ("d", "y")}


def test_near_hashes_against_all_pairs(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(60)]
    hashes = base + [h ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for h in base] + base[:5]
    df = spark.createDataFrame([(f"{h:016x}",) for h in hashes], "hash string")
    distinct = sorted({f"{h:016x}" for h in hashes})
    for d in (0, 1, 2):
        want = {(a, b, n) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (n := (int(a, 16) ^ int(b, 16)).bit_count()) <= d}
        got = D.near_pairs(df, d).collect()
        assert {tuple(g) for g in got} == want and len(got) == len(want)


def test_overlap_and_constraints(spark):
    candidates = spark.createDataFrame([("c1", "s1", "0" * 16, "ok"), ("c2", "zz", "0" * 15 + "1", "ok"), ("c3", "yy", "f" * 16, "ok"), ("c4", "s1", "0" * 16, "corrupt")], "candidate_id string, sha256 string, hash string, status string")
    reference = spark.createDataFrame([("r1", "s1", "0" * 16, 0), ("r2", "s1", "0" * 15 + "3", 1), ("r3", "s3", "0" * 15 + "1", 2)], "sample_id string, sha256 string, hash string, ord int")
    report = D.overlap_report(candidates, reference)
    assert sorted(tuple(r) for r in report.collect()) == [("c1", "s1", "r2", "exact_sha256", 0), ("c2", "zz", "r3", "near_difference_hash", 0)]
    assert {r.candidate_id for r in D.quarantine(candidates, report).collect()} == {"c3", "c4"}
    rows = spark.createDataFrame([(0, "g1", "d1"), (1, "g1", "d2"), (2, "g2", "d2"), (3, "g3", ""), (4, " ", None)], "id int, group_id string, duplicate_group string")
    got = {r.id: r.connected_group for r in D.constraint_components(rows, ["group_id", "duplicate_group"], "id").collect()}
    assert got[0] == got[1] == got[2] != got[3] and got[4] == "singleton_row=4"


def long_table(spark, y, p):
    rows = [(i, j, f"l{j}", int(y[i][j]), float(p[i][j])) for i in range(len(y)) for j in range(len(y[0]))]
    return spark.createDataFrame(rows, "sample_id int, idx int, label string, y int, p double")


def test_metrics_against_numpy(spark):
    r = np.random.default_rng(3)
    y, p = r.integers(0, 2, (80, 5)), np.round(r.random((80, 5)), 1)
    y[:, 4], y[:3] = 0, 0
    p[:2] = 0
    got = E.multilabel_metrics(long_table(spark, y, p), 0.5).first()
    h = p >= 0.5
    tp, fp, fn = (h & (y == 1)).sum(), (h & (y == 0)).sum(), (~h & (y == 1)).sum()
    f = lambda a, b, c: 2 * a / (2 * a + b + c) if 2 * a + b + c else 0.0
    per = [f((h & (y == 1))[:, j].sum(), (h & (y == 0))[:, j].sum(), (~h & (y == 1))[:, j].sum()) for j in range(4)]
    rows = [2 * (h[i] & (y[i] == 1)).sum() / (h[i].sum() + y[i].sum()) if h[i].sum() + y[i].sum() else 1.0 for i in range(80)]
    assert abs(got.micro_f1 - f(tp, fp, fn)) < 1e-12 and abs(got.macro_f1_supported - np.mean(per)) < 1e-12 and abs(got.sample_f1 - np.mean(rows)) < 1e-12
    assert got.labels == 5 and got.labels_with_test_support == 4 and got.samples == 80 and abs(got.exact_match - np.mean((h == y).all(axis=1))) < 1e-12

    def ap(a, s):
        out = last = 0.0
        for t in sorted(set(s.ravel()), reverse=True):
            k = s >= t
            recall = (a[k] == 1).sum() / max((a == 1).sum(), 1)
            out, last = out + (recall - last) * (a[k] == 1).mean(), recall
        return out

    ranks = E.ranking_metrics(long_table(spark, y, p)).first()
    assert abs(ranks.micro_average_precision - ap(y, p)) < 1e-12
    assert abs(ranks.macro_average_precision - np.mean([ap(y[:, j], p[:, j]) for j in range(4)])) < 1e-12
    order = np.argsort(-p, axis=1, kind="stable")[:, :3]
    assert abs(E.precision_at_k(long_table(spark, y, p), 3).first()[0] - np.take_along_axis(y, order, 1).mean()) < 1e-12
    assert E.precision_at_k(long_table(spark, y, p), 99).first()[0] == pytest.approx(y.mean())


def test_metric_conventions(spark):
    perfect = np.array([[1, 0, 1], [0, 1, 0]])
    got = E.multilabel_metrics(long_table(spark, perfect, perfect), 0.5).first()
    assert got.micro_f1 == got.macro_f1_supported == got.sample_f1 == got.exact_match == 1
    none = np.zeros((2, 2), int)
    assert E.multilabel_metrics(long_table(spark, none, none), 0.5).first().sample_f1 == 1
    assert E.multilabel_metrics(long_table(spark, none, np.array([[0.9, 0], [0, 0]])), 0.5).first().sample_f1 == 0.5
    base = E.prevalence_baseline(long_table(spark, np.array([[1, 1, 0], [1, 0, 0], [1, 1, 1]]), np.zeros((3, 3))))
    assert {(r.label, r.yhat, r.top_k) for r in base.collect()} == {("l0", 1, 2), ("l1", 1, 2), ("l2", 0, 2)}
    bad = spark.createDataFrame([(1, 0, "a", 2, 0.5), (1, 1, "b", 1, float("nan")), (2, 0, "a", 1, 0.1)], "sample_id int, idx int, label string, y int, p double")
    assert sorted(r.rule_id for r in V.metric_inputs(bad).collect()) == ["binary", "score_range", "shape"]


def test_sign_flips(spark):
    rows = [(g, d) for g, d in (("a", 0.5), ("b", 0.5), ("c", 0.5), ("d", 0.5)) for _ in range(5)]
    df = spark.createDataFrame(rows, "grp string, diff double")
    got = I.sign_flip_test(df).first()
    assert (got.observed, got.p_value, got.method, got.permutations) == (0.5, 2 / 16, "group_clustered_exact_sign_flip", 16)
    mc = I.sign_flip_test(df, None, 200).first()
    assert mc.method == "sample_level_monte_carlo_sign_flip" and mc.p_value == pytest.approx(1 / 201) and mc.permutations == 200
    tied = I.sign_flip_test(spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", -0.3)], "grp string, diff double")).first()
    assert tied.p_value == 1


def test_bootstrap_equals_repeating_rows(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), f"g{i % 6}", *map(int, r.integers(0, 4, 3)), float(r.random())) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id int, grp string, tp int, fp int, fn int, f1 double")
    weights = I.drawn_weights(spark, sorted({x[1] for x in rows}), 40, seed=1)
    got = I.bootstrap_interval(I.group_sums(df, []), weights).first()
    w, pdf, values = weights.toPandas(), df.toPandas(), []
    for _, draw in w.groupby("iteration"):
        sample = pd.concat([pdf[pdf.grp == g] for g, k in zip(draw.grp, draw.weight) for _ in range(int(k))])
        values.append(2 * sample.tp.sum() / (2 * sample.tp.sum() + sample.fp.sum() + sample.fn.sum()))
    assert (got.ci_lower, got.ci_upper) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])))
    same = I.bootstrap_difference(I.group_sums(df, []), I.group_sums(df, []), weights).first()
    assert (same.estimate, same.ci_lower, same.ci_upper) == (0, 0, 0)
    custom = I.bootstrap_custom(df, weights, lambda d: 2 * d.tp.sum() / (2 * d.tp.sum() + d.fp.sum() + d.fn.sum())).first()
    assert custom.ci_lower == pytest.approx(got.ci_lower)
    counts = I.hashed_weights(df, 10).groupBy("iteration").agg(F.sum("weight").alias("w")).collect()
    assert {c.w for c in counts} == {6} and len(counts) == 10


ANSWER = {"food_name": "Soto", "visible_ingredients": ["Egg", "rice"], "uncertain_ingredients": ["fried shallot"], "abstain": False, "reason": "seen"}


@pytest.mark.parametrize(
    "raw, code",
    [
        (json.dumps(ANSWER), ""), (None, "no_json_object"), ("```json\n" + json.dumps(ANSWER) + "\n```", "non_json_envelope"), ("{nope}", "json_error"), ('{"a": {"b": 1, "b": 2}}', "duplicate_key:b"), (json.dumps({**ANSWER, "x": 1}), "schema_keys:missing=[],extra=['x']"),
        (json.dumps({**ANSWER, "food_name": " "}), "food_name_not_nonempty_string"), (json.dumps({**ANSWER, "reason": 3}), "reason_not_nonempty_string"), (json.dumps({**ANSWER, "abstain": 0}), "abstain_not_boolean"),
        (json.dumps({**ANSWER, "visible_ingredients": "egg"}), "ingredient_fields_not_string_lists"), (json.dumps({**ANSWER, "visible_ingredients": ["egg", "EGG"]}), "duplicate_ingredient_ids"), (json.dumps({**ANSWER, "visible_ingredients": ["blue"]}), "unknown_ingredient_ids"),
        (json.dumps({**ANSWER, "uncertain_ingredients": ["egg"]}), "visible_uncertain_overlap"), (json.dumps({**ANSWER, "abstain": True}), "abstain_with_labels"),
    ],
)
def test_strict_answers(spark, raw, code):
    got = R.parse_answers(spark.createDataFrame([(raw,)], "raw_output string"), FOOD.ids).first()
    assert got.parse_error.startswith(code) and got.parse_ok == (code == "") and (got.visible == ["rice", "egg"]) == (code == "")
    if code:
        assert got.abstain and not got.visible and not got.uncertain and (got.unknown_labels == ["blue"]) == (code == "unknown_ingredient_ids")


def test_item_lists(spark):
    cases = {"['a, b', 'c']": ["a, b", "c"], "a; b|c,d": ["a", "b", "c,d"], "[broken": ["[broken"], "": [], "nan": ["nan"]}
    for text, want in cases.items():
        assert one(spark, R.item_list(F.col("t")), t=text) == want
    assert spark.range(1).select(R.item_list(F.lit(None).cast("string")).alias("x")).first()["x"] == []


def test_energy(spark):
    rows = [(1500.0, 50.0, 20.0, 30.0), (float("nan"), 20.0, 10.0, 5.0), (165.0, 20.0, 10.0, 5.0), (float("inf"), 60.0, 60.0, -1.0)]
    got = R.energy_check(spark.createDataFrame(rows, "e double, p double, c double, f double"), "e", "p", "c", "f").collect()
    assert got[0].errors == ["energy_exceeds_physical_bound", "atwater_energy_mismatch"] and got[1].errors == ["non_finite_value"] and got[2].valid and got[3].errors == ["non_finite_value", "negative_value", "macros_exceed_100g"]
    with pytest.raises(ValueError):
        R.energy_check(spark.createDataFrame(rows, "e double, p double, c double, f double"), "e", "p", "c", "f", 2)


def test_sampling(spark):
    df = spark.createDataFrame([(f"i{i}", f"c{i % 3}") for i in range(90)], "id string, food_class string")
    pool = S.reserve_pool(df, "food_class", "id", 20)
    assert pool.count() == 60 and {r.candidate_rank for r in pool.collect()} == set(range(1, 21))
    sealed = S.sealed_split(pool, "food_class", "id", strict=True)
    again = S.sealed_split(S.reserve_pool(df.repartition(5), "food_class", "id", 20), "food_class", "id")
    assert sorted(map(tuple, sealed.select("id", "split").collect())) == sorted(map(tuple, again.select("id", "split").collect()))
    assert V.split_sizes(sealed, {"train": 12, "validation": 4, "test": 4}).count() == 0 and V.split_sizes(sealed.limit(59), {"train": 12, "validation": 4, "test": 4}).count() > 0
    with pytest.raises(ValueError):
        S.reserve_pool(df, "food_class", "id", 31, strict=True)
    order = [r.id for r in S.shuffled(df, "id", 101).collect()]
    assert order != [r.id for r in S.shuffled(df, "id", 202).collect()] and sorted(order) == sorted(f"i{i}" for i in range(90))


def test_grouped_split(spark):
    rows = [(i, f"g{i // 2}", ["a", "b"] if i // 2 % 2 else ["c"]) for i in range(80)] + [(99, "g99", [])]
    got = S.grouped_split(spark.createDataFrame(rows, "id int, g string, labels array<string>"), "g", "labels").collect()
    by = {}
    for r in got:
        assert by.setdefault(r.g, r.split) == r.split
    sizes = {s: sum(r.split == s for r in got) for s in ("train", "validation", "test")}
    assert len(got) == 81 and abs(sizes["train"] - 57) <= 4 and min(sizes.values()) >= 8


def test_worklist(spark):
    rows = [("a", 1, "accept"), ("a", 2, ""), ("a", 3, ""), ("b", 1, ""), ("b", 2, "accept"), ("c", 1, "accept")]
    screen = spark.createDataFrame(rows, "food_class string, candidate_rank int, decision string")
    head = lambda *a: tuple(S.worklist_head(screen, "food_class", *a).first())[:2]
    assert head(2, "a", 2) == ("a", 3) and head(2, "a", 3) == ("a", 2) and head(2, "c") == ("a", 2) and head(2) == ("a", 2)
    assert S.worklist_head(screen, "food_class", 1).count() == 0
    assert S.next_pending(screen, "candidate_rank", 2, F.col("decision") == "").first().candidate_rank == 3


def sheets(spark):
    manifest = spark.createDataFrame([("a", "p1", "A", "train"), ("b", "p2", "B", "test")], "sample_id string, relative_path string, food_class string, split string")
    fill = lambda who, a, b: A.new_sheet(manifest, who).withColumn("visible_ingredients", F.when(F.col("sample_id") == "a", a).otherwise(b))
    return manifest, fill("x", "rice|egg", "tofu"), fill("y", "egg;nasi", "tofu|egg")


def test_annotation_flow(spark):
    manifest, a, b = sheets(spark)
    assert V.annotation_sheet(a, manifest, FOOD, complete=True).count() == 0
    got = A.agreement(a, b, FOOD).first()
    assert (got.mean_jaccard, got.exact_set_agreement, got.micro_cell_agreement, got.unreadable_agreement) == (0.75, 0.5, 1 - 1 / 16, 1)
    kappas = {r.label: r.kappa for r in A.label_kappas(a, b, FOOD).collect()}
    assert kappas["rice"] == 1 and kappas["noodles"] is None and kappas["egg"] == 0
    queue = A.adjudication_queue(manifest, a, b, FOOD)
    assert {r.sample_id: (r.status, r.resolved_visible_ingredients) for r in queue.collect()} == {"a": ("agreement", "rice|egg"), "b": ("needs_adjudication", "")}
    assert A.unresolved(queue).count() == 1
    settled = queue.withColumns({"resolution_notes": F.when(F.col("sample_id") == "b", "looked again").otherwise(""), "resolved_visible_ingredients": F.when(F.col("sample_id") == "b", "tofu").otherwise(F.col("resolved_visible_ingredients"))})
    assert A.unresolved(settled).count() == 0
    final = {r.sample_id: r for r in A.combined(A.normalised(a, FOOD), A.finalised(settled, FOOD)).collect()}
    assert final["a"].annotation_source == "primary_annotator_only" and final["b"].annotation_source == "double_annotated_adjudicated" and final["b"].visible_ingredients == "tofu"
    assert tuple(A.annotation_progress(A.new_sheet(manifest, "z"), FOOD).first()) == (0, 2, 2)
    assert V.stale_rows(queue, queue.withColumn("split", F.lit("test")), ["sample_id", "split"]).count() == 2


def test_validators(spark):
    manifest, a, _ = sheets(spark)
    rules = lambda df: sorted({r.rule_id for r in df.collect()})
    assert rules(V.annotation_sheet(a.withColumn("uncertain_ingredients", F.lit("tofu|egg")), manifest, FOOD)) == ["visible_uncertain_overlap"]
    assert rules(V.annotation_sheet(a.withColumn("unreadable", F.lit("true")), manifest, FOOD)) == ["flag_with_labels"]
    assert rules(V.annotation_sheet(A.new_sheet(manifest, "z"), manifest, FOOD, complete=True)) == ["blank_row"]
    assert rules(V.annotation_sheet(a.limit(1).union(a.limit(1)), manifest, FOOD)) == ["id_set_missing", "id_set_repeated"]
    with pytest.raises(ValueError, match="missing columns"):
        V.annotation_sheet(a.drop("unreadable"), manifest, FOOD)
    with pytest.raises(ValueError, match="visible_uncertain_overlap"):
        V.check(V.annotation_sheet(a.withColumn("uncertain_ingredients", F.lit("tofu|egg")), manifest, FOOD))
    pool = spark.createDataFrame([("k1", 1, "p", "A"), ("k2", 2, "q", "A")], "candidate_id string, candidate_rank int, relative_path string, food_class string")
    screen = A.new_screen(pool)
    assert V.quality_screen(screen, pool, 1).count() == 0
    assert rules(V.quality_screen(screen.withColumn("decision", F.lit("accept")), pool, 1)) == ["class_quota"]
    assert rules(V.quality_screen(screen.withColumns({"decision": F.lit("reject"), "rejection_reason": F.lit("other")}), pool, 1)) == ["other_without_note"]
    assert {r.food_class: (r.needed, r.complete) for r in A.screen_progress(screen, ["A", "B"], 1).collect()} == {"A": (1, False), "B": (1, False)}
    assert rules(V.class_inventory(inv(spark, [("a", "x", "ok", "", "")]), ["x", "y"])) == ["class_missing"]
    cache = spark.createDataFrame([("a", "A", "m1"), ("a", "A", "m2"), ("z", "A", "m1")], "sample_id string, food_class string, model_id string")
    assert rules(V.model_cache(cache, manifest, ["model_id"])) == ["mixed_model_id", "repeated_id", "unknown_id"]


def test_sources(spark, tmp_path):
    root = tmp_path / "images"
    for name in ("food/one.PNG", "food/two.txt", "other/three.jpeg"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"not an image " + name.encode())
    got = images.inventory(spark, str(root)).collect()
    assert {(r.relative_path, r.food_class, r.status, r.sha256, r.dhash) for r in got} == {("food/one.PNG", "food", "corrupt", "", ""), ("other/three.jpeg", "other", "corrupt", "", "")}
    assert images.difference_bits(np.zeros((8, 9))) == "f" * 16 and images.difference_bits(np.tile(np.arange(9, 0, -1), (8, 1))) == "0" * 16
    df = spark.createDataFrame([("a", ""), ('q "x"\nline', None)], "x string, y string")
    tables.write_csv(df, str(tmp_path / "t"), one_file=True)
    assert {r.x for r in tables.read_csv(spark, str(tmp_path / "t")).collect()} == {"a", 'q "x"\nline'}
    with pytest.raises(Exception, match="exists"):
        tables.write_table(df, str(tmp_path / "t"))
    tables.write_json({"b": 1}, str(tmp_path / "x" / "j.json"))
    assert tables.read_json(str(tmp_path / "x" / "j.json")) == {"b": 1}
    (tmp_path / "small.csv").write_text("Title,Ingredients,Image_Name\n")
    paths = spark.createDataFrame([("a/same.jpg",), ("b/same.jpg",), ("c/unique.png",), ("d/Soto Ayam.jpg",)], "path string")
    rows = spark.createDataFrame([("Soto", "['rice', 'egg']", "same"), ("", "rice; tofu", "unique"), ("X", "blue", "unique.png"), ("Y", "egg", "a\\same.jpg"), ("Z", "egg", None)], "Title string, Ingredients string, Image_Name string")
    ready = {r.group_id: (r.image_path, r.labels) for r in recipes.prepare(rows, paths, FOOD).collect()}
    assert ready == {"unique": ("c/unique.png", ["rice", "tofu"]), "y": ("a/same.jpg", ["egg"])}
    with pytest.raises(ValueError):
        recipes.prepare(rows.limit(0), paths, FOOD)
    assert recipes.largest_csv(spark, str(tmp_path)).endswith(".csv")


SETTINGS = {
    "benchmark": {"samples_per_class": 20, "train_per_class": 12, "validation_per_class": 4, "test_per_class": 4, "expected_classes": [f"c{i}" for i in range(13)], "required_annotators": 2, "secondary_annotation_splits": ["validation", "test"], "quality_candidates_per_class": 100, "quality_screen_version": "v"},
    "training": {"image_size": 1, "batch_size": 1, "pretraining_epochs": 1, "finetuning_epochs": 1, "learning_rate": 0.1, "weight_decay": 0, "recipe_split_fractions": {"train": 0.7, "validation": 0.15, "test": 0.15}, "global_threshold_grid": [0.1, 0.5]},
    "vlm": {"model_id": "m", "revision": "r", "prompt_version": "p"},
    "evaluation": {"bootstrap_iterations": 1, "confidence_level": 0.95, "permutation_iterations": 1, "precision_at_k": 5},
}


def test_config(tmp_path):
    assert config.problems(SETTINGS) == []
    bad = json.loads(json.dumps(SETTINGS))
    bad["benchmark"]["expected_classes"][1] = "c0"
    bad["training"]["global_threshold_grid"] = [0.5, 0.1]
    (tmp_path / "c.json").write_text(json.dumps(bad))
    with pytest.raises(ValueError, match="repeat.*rise"):
        config.load(str(tmp_path / "c.json"))


def test_provenance(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, "A", "train"), ("a", None, "A", "test")], "sample_id string, n int, food_class string, split string")
    assert P.csv_digest(df, "sample_id") == P.csv_digest(df.repartition(3), "sample_id") and P.table_digest(df).first() == P.table_digest(df.repartition(3)).first()
    assert P.table_digest(df).first() != P.table_digest(df.na.fill(0)).first()
    seal = P.lock(df, "sample_id", {"config": P.json_digest({"b": 1, "a": 2})}, version="v1")
    assert seal["split_counts"] == {"test": 1, "train": 1} and P.changed(seal, {"config": P.json_digest({"a": 2, "b": 1})}) == [] and P.changed(seal, {}) == ["config"]
    f = tmp_path / "f.txt"
    f.write_text("x")
    assert P.sealed_test_gate({"f": str(f), "g": str(f) + "2"}, {"f": P.file_digest(str(f))}, False) == ["missing g", "not confirmed"]
    assert P.run_manifest(spark, str(tmp_path), {"f": str(f)})["artifacts"] == {"f": P.file_digest(str(f))} and P.protocol_digest(str(tmp_path), ["f.txt"])
    blocked = P.render_results({"status": "blocked", "systems": [{"name": "hidden", "micro_f1": 0.123}]})
    assert "blocked" in blocked and "0.123" not in blocked
    done = P.render_results({"status": "complete", "systems": [{"name": "cnn", "micro_f1": 0.5, "ci_lower": 0.4, "ci_upper": 0.6}], "paired": {"estimate": 0.1, "ci_lower": 0.0, "ci_upper": 0.2, "p_value": 0.03, "method": "m"}, "counts": {"rows": 3}})
    assert "| cnn | 0.5000" in done and "p = 0.0300" in done and "| rows | 3 |" in done


def test_incremental(spark, tmp_path):
    items, done = spark.range(5).withColumnRenamed("id", "k"), spark.createDataFrame([(1, "old"), (9, "gone")], "k long, v string")
    got = incremental.resumed(items, done, "k", lambda df: df.withColumn("v", F.lit("new"))).collect()
    assert {r.k: r.v for r in got} == {0: "new", 1: "old", 2: "new", 3: "new", 4: "new"}
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed = lambda rows: spark.createDataFrame(rows, "k long, seq long, v string").coalesce(1).write.mode("append").parquet(src)
    feed([(1, 1, "a"), (2, 1, "b")])
    stream = spark.readStream.schema("k long, seq long, v string").parquet(src)

    def run():
        q = incremental.upsert(stream, out, "k", "seq", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    feed([(1, 2, "c"), (3, 1, "d")])
    run()
    assert {r.k: r.v for r in BucketedStore(spark, out, "k", "seq").table().collect()} == {1: "c", 2: "b", 3: "d"}


def test_streaming_dedup(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.createDataFrame([("u", "h", 0), ("u", "h", 5), ("w", "h", 1)], "url string, hash string, s int").withColumn("ts", F.timestamp_seconds("s")).write.parquet(src)
    stream = spark.readStream.schema("url string, hash string, s int, ts timestamp").parquet(src)
    q = incremental.dedup_stream(stream, ["url", "hash"], "ts").writeStream.format("memory").queryName("dedup_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup_out").count() == 2


def test_quantile_and_rounding_agree_with_numpy(spark):
    x = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert x.select(F.sum(F.bround("x", 0))).first()[0] == sum(map(round, (0.5, 1.5, 2.5))) and math.isclose(x.agg(F.percentile("x", 0.025)).first()[0], np.quantile([0.5, 1.5, 2.5], 0.025))


def test_compatibility_characters_get_labels(spark):
    df = spark.createDataFrame([("ＲＩＣＥ and ｅgg",), ("rice　egg",), (None,), ("",)], "t string")
    got = [r.x for r in df.select(FOOD.extract(F.col("t")).alias("x")).collect()]
    assert got == [["rice", "egg"], ["rice", "egg"], [], []]
    assert df.select(FOOD.canonical(F.lit("Ｒice")).alias("c")).first().c == "rice"
    assert df.select(FOOD.parse_cell(F.lit("ｅgg|？")).alias("c")).first().c.asDict()["labels"] == ["egg"]
    forms = ["ﬁ ½ Å é", "ﾊﾝ", "①", "plain"]
    shown = spark.createDataFrame([(x,) for x in forms], "t string").select(T.nfkc(F.col("t")).alias("n")).collect()
    assert [r.n for r in shown] == [unicodedata.normalize("NFKC", x) for x in forms]


def test_checked_joins(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, x string")
    right = spark.createDataFrame([(1, "r"), (3, "s")], "k int, y string")
    assert sorted((r.x, r.y) for r in J.many_to_one(left, right, ["k"]).collect()) == [("a", "r"), ("b", "r"), ("c", None)]
    assert tuple(J.coverage(left, right, ["k"]).first()) == (3, 2)
    for wrong in (lambda: J.many_to_one(left, right, ["k"], covered=True), lambda: J.many_to_one(right, left, ["k"]), lambda: J.one_to_one(left, right, ["k"])):
        with pytest.raises(ValueError):
            wrong()
    assert J.one_to_one(left.where("x <> 'b'"), right, ["k"]).count() == 1


def test_combining_needs_full_cover(spark):
    manifest, a, b = sheets(spark)
    queue = A.adjudication_queue(manifest, a, b, FOOD)
    with pytest.raises(ValueError, match="open"):
        A.finalised(queue, FOOD)
    noted = queue.withColumn("resolution_notes", F.lit("seen"))
    with pytest.raises(ValueError, match="blank_row"):
        A.finalised(noted, FOOD)
    final = A.finalised(noted.withColumn("resolved_visible_ingredients", F.lit("egg")), FOOD)
    first = A.normalised(a, FOOD)
    held = final.where("split = 'test'")
    assert A.combined(first, held, manifest).count() == 2
    for one, two in ((first.where("split = 'test'"), held), (first, held.limit(0)), (first, final), (first, held.union(held))):
        with pytest.raises(ValueError):
            A.combined(one, two, manifest)


def test_votes_rates_and_selection(spark):
    rows = [("A", "rice", "egg", "x.org"), ("A", "rice", None, "y.org"), ("A", "rice rice", "", "x.org"), ("A", "tofu", "", " "), ("B", None, "tofu", "x.org")]
    evidence = spark.createDataFrame(rows, "food_class string, title string, snippet string, domain string")
    got = {tuple(r) for r in source_votes(evidence, FOOD, minimum=2).collect()}
    assert got == {("A", "rice", 2, True), ("A", "egg", 1, False), ("B", "tofu", 1, False)}
    seen = spark.createDataFrame([("g", True, None), ("g", False, True), ("h", True, False)], "g string, ok boolean, idle boolean")
    assert {tuple(r) for r in E.rates(seen, ["g"], ok=F.col("ok"), idle=F.col("idle")).collect()} == {("g", 0.5, 0.5, 2), ("h", 1.0, 0.0, 1)}
    runs = spark.createDataFrame([("big", 0.5), ("small", 0.5), ("bad", 0.1)], "name string, ap double")
    assert E.select_model(runs, "ap", "small").first().name == "small" and E.select_model(runs, "ap", "bad").first().name == "big"


def test_a_blank_group_represents_nothing(spark):
    df = spark.createDataFrame([("A", "g", "1"), ("B", "g", "2"), ("A", "", ""), ("B", "", "")], "food_class string, duplicate_group string, sha256 string")
    assert [tuple(r) for r in D.representatives(df).collect()] == [("A", "g", "1")]


def test_groups_of_any_size_are_named_by_one_rule(spark):
    """Nine tenths of the rows in one group, over many batches."""
    df = spark.range(9000).select("id", F.lit("one").alias("a"), F.concat(F.lit("v"), "id").alias("b"))
    df = df.unionByName(spark.range(9000, 10_000).select("id", F.concat(F.lit("w"), F.expr("id div 2")).alias("a"), F.lit(None).cast("string").alias("b")))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.id: r.connected_group for r in D.constraint_components(df.repartition(5), ["a", "b"], "id").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    name = lambda tokens: "connected-" + hashlib.sha256("\n".join(sorted(tokens)).encode()).hexdigest()[:16]
    large = name(["a=one", *(f"b=v{i}" for i in range(9000))])
    assert got == {i: large if i < 9000 else name([f"a=w{i // 2}"]) for i in range(10_000)}


def test_sign_flips_of_rows_repeat(spark):
    df = spark.createDataFrame([(i, (-1) ** i * i / 50) for i in range(40)], "sample_id int, diff double")
    one, two = (I.sign_flip_test(d, group=None, iterations=500).first() for d in (df, df.repartition(5)))
    assert one.p_value == two.p_value and one.method == "sample_level_monte_carlo_sign_flip"


def test_durable_tables_grow_with_what_they_read(spark, monkeypatch):
    from sieveline.plans import durable as P

    wide = spark.range(100_000).repartition(32)
    assert P.durable(wide).rdd.getNumPartitions() <= P.WAVES * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(P, "FILE_BYTES", 10_000)
    assert P.durable(P.durable(wide).where("id > 5").repartition(32)).rdd.getNumPartitions() == 32
