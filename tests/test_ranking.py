import math

from pyspark.sql import functions as F

from jobatlas.functions.scoring import DIMENSIONS, has_personal_signal
from jobatlas.operators import guidance, quality, ranking
from jobatlas.plans.recommend import career_features, recommend
from jobatlas.schemas import CAREER, PROFILE


def dims(*v):
    return dict(zip(DIMENSIONS, map(float, v)))


def profile(sid, d, skills=(), interests=(), mode="explore", region=None, exps=()):
    return (sid, mode, None, None, d, [(n, "", q) for n, q in skills], list(interests), (region, None, None, ""), [], list(exps), 0.0)


CAREERS = [
    (f"c{i}", "Career " + "ABCDEFGH"[i], "", [f"career {i}"], None, dims(*[1.0 if j == i % 5 else 0.2 for j in range(5)]), [("university", "Uni", "", ["x"])], []) for i in range(8)
]
PEOPLE = [
    profile("p1", dims(0.8, 0.1, 0, 0, 0), [("Python", "đã làm"), ("C", "")], ["vẽ"]),
    profile("p2", dims(0, 0, 0, 0, 0), [], ["Excel nâng cao"], "launch", "hcm", [("Shop app", "project", "", ["SQL"], "làm app")]),
]
STATS = [(f"c{i}", "all", 40 * i, 3, None, None, None, 0, None if i % 2 else 10.0 * i, bool(i % 2), ["Python", "Excel", "SQL", "CI/CD"][: i % 5], ["hcm"]) for i in range(7)]
STATS_SCHEMA = ("career_id string, region string, demand_count_90d long, entry_level_count_90d long, salary_p25_trieu double, salary_p50_trieu double, "
                "salary_p75_trieu double, salary_sample_count long, trend_pct double, low_confidence boolean, top_skills array<string>, top_regions array<string>")


def frames(spark):
    return spark.createDataFrame(PEOPLE, PROFILE), spark.createDataFrame(CAREERS, CAREER), spark.createDataFrame(STATS, STATS_SCHEMA)


def expected(p, career):
    """The score written out for one pair."""
    a, b = [p[4][k] for k in DIMENSIONS], [career[5][k] for k in DIMENSIONS]
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    cos = sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0
    stat = next((s for s in STATS if s[0] == career[0]), None)
    tops = {t.lower() for t in (stat[10] if stat else [])}
    w = {}
    for n, _, q in p[5]:
        w[n.lower()] = max(w.get(n.lower(), 0), 1.0 if q else 0.6)
    for i in p[6]:
        w[i.lower()] = max(w.get(i.lower(), 0), 0.5)
    for t, _, _, sk, _ in p[9]:
        for s in sk:
            w[s.lower()] = max(w.get(s.lower(), 0), 0.9)
        w[t.lower()] = max(w.get(t.lower(), 0), 0.4)

    def hit(x, y):
        return x == y or (min(len(x), len(y)) >= 3 and (x in y or y in x))

    best = {t: max([w[x] for x in w if hit(x, t)], default=None) for t in tops}
    matched = [v for v in best.values() if v is not None]
    skill = 0.5 * len(matched) / max(1, len(tops | set(w))) + 0.5 * min(1, sum(matched) / max(1, len(tops))) if tops else 0.0
    demand, trend = (stat[2], stat[8] or 0.0) if stat else (0, 0.0)
    m = min(1, math.log1p(demand) / math.log1p(2000)) * (1 + max(-50, min(100, trend)) / 200) / 1.5
    if p[7][0] == "hcm" and stat:
        m = min(1, m * 1.05)
    return min(1.0, 0.5 * cos + 0.3 * skill + min(0.35, 0.2 * m))


def test_scores_equal_direct_computation(spark):
    people, careers, stats = frames(spark)
    rows = ranking.explode_ranked(ranking.rank_careers(people, career_features(careers, stats))).collect()
    for p in PEOPLE:
        want = sorted(((-expected(p, c), c[0]) for c in CAREERS))
        got = [r for r in sorted(rows, key=lambda r: r["rank"]) if r["session_id"] == p[0]]
        assert [r["career_id"] for r in got] == [c for _, c in want]
        assert all(abs(r["total"] + s) < 1e-9 for r, (s, _) in zip(got, want))


def test_many_packs_give_the_same_ranking(spark, monkeypatch):
    people, careers, stats = frames(spark)
    features = career_features(careers, stats)
    one = ranking.explode_ranked(ranking.rank_careers(people, features)).collect()
    monkeypatch.setattr(ranking, "pack", lambda d, i: __import__("jobatlas.operators.packs", fromlist=["pack"]).pack(d, i, 3))
    many = ranking.explode_ranked(ranking.rank_careers(people, features)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_stretch_differs_in_dimension(spark):
    people, careers, stats = frames(spark)
    ranked = ranking.with_stretch(ranking.rank_careers(people, career_features(careers, stats)))
    for r in ranked.collect():
        shown = [c["career_id"] for c in r["shown"]]
        assert len(shown) == 5 and r["stretch"]["career_id"] not in shown


def test_what_if_leaves_the_profile_alone(spark):
    people, careers, stats = frames(spark)
    features = career_features(careers, stats)
    before = people.orderBy("session_id").collect()
    assert ranking.what_if(people, features, F.lit(" excel ")).count() > 0
    assert ranking.what_if(people, features, F.lit("GPA 4.0")).count() == 0
    assert people.orderBy("session_id").collect() == before


def test_recommendations_are_grounded_and_ready(spark):
    people, careers, stats = frames(spark)
    from jobatlas.operators.explain import grounding_violations

    rows = recommend(people, careers, stats, "s1")
    got = rows.collect()
    assert len(got) == 12 and sum(r["is_stretch"] for r in got) == 2
    assert all(len(r["routes"]) == 2 and r["routes"][1]["type"] == "certificate" or r["journey_mode"] == "launch" for r in got)
    assert all((r["job_readiness"] is not None) == (r["journey_mode"] == "launch") for r in got)
    assert grounding_violations(rows, ["session_id", "career_id"]).count() == 0
    assert quality.readiness_violations(rows, "career_id").count() == 0
    assert quality.route_violations(rows).count() == 0


def test_region_changes_nothing_but_the_small_boost(spark):
    people, careers, stats = frames(spark)
    features = career_features(careers, stats)
    other = people.withColumn("constraints", F.col("constraints").withField("region_pref", F.lit("danang")))
    audit = quality.invariance_audit(ranking.rank_careers(people, features), ranking.rank_careers(other, features), "session_id").collect()
    assert all(r["same_candidates"] for r in audit)


def test_personal_signal(spark):
    people = spark.createDataFrame([profile("x", dims(0.1, 0, 0, 0, 0)), profile("y", dims(0.3, 0, 0, 0, 0))], PROFILE)
    flags = people.select("session_id", has_personal_signal(F.col("skills"), F.col("interests"), F.col("experiences"), F.col("job_goal"), F.col("dimensions"))).collect()
    assert [r[1] for r in sorted(flags)] == [False, True]


def test_gap_and_actions(spark):
    people, _, _ = frames(spark)
    ev = guidance.evidenced_skills(F.col("skills"), F.col("experiences"))
    row = people.where("session_id = 'p2'").select(
        guidance.matched_missing(ev, F.array(F.lit("SQL"), F.lit("Excel"), F.lit("sql "), F.lit("C"))).alias("g")).select(
        "g", guidance.weekly_actions(F.col("g.missing"), F.col("g.matched")).alias("w"), guidance.search_queries(F.lit("Nam Dev"), F.array(F.lit("dev")), F.col("g.missing")).alias("q")).first()
    assert [m["skill"] for m in row["g"]["matched"]] == ["SQL"] and row["g"]["missing"] == ["Excel", "C"]
    assert [w["week"] for w in row["w"]] == [1, 2, 3, 4] and "SQL" in row["w"][2]["action"]
    assert row["q"] == ["dev junior", "Nam Dev junior"]


def test_profiles_are_compared_with_each_skill_once(spark):
    """Skills that careers share are kept once in a pack, whose careers hold their places only."""
    people, careers, stats = frames(spark)
    features = career_features(careers, stats)
    packs, n = ranking.pack(features, ranking.career_item())
    shared = ranking._share_skills(packs).first()
    want = {r.career_id: [s.lower() for s in r.top_skills] for r in features.select("career_id", "top_skills").collect()}
    assert n == 1 and sorted(shared.known) == sorted({s for skills in want.values() for s in skills})
    assert {c.career_id: [shared.known[i] for i in c["at"]] for c in shared["items"]} == want
