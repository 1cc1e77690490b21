import random
import re

from pyspark.sql import functions as F

from jobatlas.operators import incremental, matching

TAXONOMY = [
    ("React Native", ["react native"], 0), ("React", ["react", "reactjs"], 1), ("Python", ["python"], 2), ("SQL", ["sql", "my sql"], 3),
    ("C++", ["c++"], 4), (".NET", [".net"], 5), ("Kế toán", ["kế toán", "ke toan"], 6), ("Native SQL", ["native sql"], 7), ("C", ["c"], 8),
]


def aliases(spark):
    return matching.alias_table(spark.createDataFrame(TAXONOMY, "name string, aliases array<string>, taxonomy_order int"))


def tags(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("text", matching.posting_text(F.lit(""), F.col("text")))
    got = {r["id"]: r["skills"] for r in matching.tag_skills(df, aliases(spark)).collect()}
    return [got.get(i, []) for i in range(len(texts))]


def test_overlap_negation_and_sections(spark):
    assert tags(spark, [
        "Build React Native apps", "React and react native", "Python is not required, SQL is", "không yêu cầu biết Python",
        "C++ and .NET, also C.", "asp.net mvc", "Cần SQL\nQuyền lợi\nHọc python", "react native sql", "pythonic", "kế toán trưởng",
    ]) == [
        ["React Native"], ["React Native", "React"], ["SQL"], [], ["C++", ".NET", "C"], [], ["SQL"], ["React Native", "SQL"], [], ["Kế toán"],
    ]


def brute(text):
    """Longest-first selection written directly over all occurrences."""
    found = []
    for name, names, order in TAXONOMY:
        for alias in {name.lower(), *names}:
            for m in re.finditer(rf"(?<!\w){re.escape(alias)}(?!\w)", text):
                found.append((-(m.end() - m.start()), m.start(), order, m.end(), name))
    taken, names = [], set()
    for _, start, order, end, name in sorted(found):
        if all(end <= s or e <= start for s, e in taken):
            taken.append((start, end))
            names.add((order, name))
    return [n for _, n in sorted(names)]


def test_greedy_selection_equals_brute_force(spark):


    rng = random.Random(3)
    words = ["react", "native", "sql", "my", "python", "c++", ".net", "kế", "toán", "c", "x,", "and"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    assert tags(spark, texts) == [brute(t) for t in texts]


def test_every_kind_of_alias_against_a_scan(spark):
    """Words, pairs, long phrases, signs before, after and alone, aliases that overlap themselves; with negations."""
    rng = random.Random(8)
    names = ["a b", "b a", "a a", "a b a", "a", "b", "c++", ".net", "#", "++", "x-y", "a b c d", "-a-", "đ e", "c"]
    rows = [(n, [], i) for i, n in enumerate(names)]
    table = matching.alias_table(spark.createDataFrame(rows, "name string, aliases array<string>, taxonomy_order int"))
    bits = ["a", "b", "c", "d", "x-y", "c++", ".net", "#", "++", "+++", "-a-a-", "not", "không yêu cầu", "đ", "e", ",", "not required", "x", "y#", "a-"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)] + ["", "++", "a", "#a#", "a a a a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["skills"] for r in matching.tag_skills(df, table).collect()}
    seen = {(r["id"], r["skill"]) for r in matching.find_skills(df, table).collect()}
    for i, text in enumerate(texts):
        found = []
        for order, alias in enumerate(names):
            for m in re.finditer(rf"(?<!\w){re.escape(alias)}(?!\w)", text):
                before, after = text[max(0, m.start() - 55) : m.start()], text[m.end() : m.end() + 35]
                no = re.search(r"(?:không|chưa)\s+(?:yêu cầu|bắt buộc|cần)(?:\s+(?:ứng viên|phải|biết|sử dụng|thành thạo)){0,4}\s*$|(?:not|required no|without)\s+$", before)
                if not no and not re.match(r"\s*(?:là\s+)?(?:không|chưa)\s+(?:bắt buộc|cần thiết|yêu cầu)|\s*(?:is\s+)?not\s+required", after):
                    found.append((m.start() - m.end(), m.start(), order, m.end()))
            assert ((i, alias) in seen) == bool(re.search(rf"(?<!\w){re.escape(alias)}(?!\w)", text)), (text, alias)
        taken, kept = [], set()
        for _, start, order, end in sorted(found):
            if all(end <= s or e <= start for s, e in taken):
                taken.append((start, end))
                kept.add(order)
        assert got.get(i, []) == [names[k] for k in sorted(kept)], text


def test_title_mapping(spark):
    kb = spark.createDataFrame([("web", ["web developer", "developer"]), ("data", ["data analyst", "analyst"]), ("qa", ["qa"]), ("ops", ["hr"])],
                               "career_id string, title_patterns array<string>")
    titles = ["Web Developer", "Senior web developer (remote)", "QA / HR", "Chef", "Data Analyst - Developer", "developers"]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    got = {r["id"]: (r["career_id"], r["reason"]) for r in matching.map_postings(df, matching.pattern_table(kb)).collect()}
    assert got[0] == ("web", "exact_title_pattern") and got[1] == ("web", "contained_title_pattern")
    assert got[2] == ("unmapped", "ambiguous_title_pattern") and got[3] == ("unmapped", "no_title_pattern")
    assert got[4] == ("data", "contained_title_pattern") and got[5][0] == "unmapped"


def test_external_batch_is_all_or_nothing(spark):
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "batch_id long, posting_id string")
    given = spark.createDataFrame([(1, "a", ["ReactJS"], ["Rust", "chăm chỉ"]), (1, "b", ["sql"], []), (2, "c", ["Cobol"], [])],
                                  "batch_id long, posting_id string, skills array<string>, new_skills array<string>")
    got = {r["posting_id"]: r for r in incremental.accept_external(asked, given, aliases(spark)).collect()}
    assert got["a"]["skills"] == ["React"] and got["a"]["new_skills"] == ["Rust"] and got["b"]["skills"] == ["SQL"]
    assert not got["c"]["batch_ok"] and got["c"]["skills"] == []


def test_requests_are_bounded(spark):
    rows = spark.range(2357).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("d").alias("description"))
    sizes = incremental.extraction_requests(rows).groupBy("batch_id").count()
    assert sizes.agg(F.max("count"), F.sum("count")).first() == (10, 2357)

    def upper(batches):
        for b in batches:
            yield b.assign(skills=[["SQL"]] * len(b), new_skills=[[]] * len(b))[["batch_id", "posting_id", "skills", "new_skills"]]

    asked = incremental.extraction_requests(rows.limit(25))
    assert incremental.accept_external(asked, incremental.run_extractor(asked, upper), aliases(spark)).where("batch_ok").count() == 25


def test_first_substring_among_many_patterns(spark):
    """Short, empty and overlapping patterns; one title fills a third of the table."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    patterns = [(f"c{i % 40}", i % 40, i // 40, word(rng.randint(1, 7)).upper()) for i in range(160)]
    titles = [word(rng.randint(0, 14)) for _ in range(200)] + ["abc abc"] * 100 + [None]
    base = spark.createDataFrame(patterns, "career_id string, career_pos int, pattern_pos int, pattern string")
    rows = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    got = {r["id"]: (r["career_id"], r["matched_pattern"]) for r in matching.map_first_substring(rows, base).collect()}
    for i, title in enumerate(titles):
        hits = sorted((pos, k, c, p.lower()) for c, pos, k, p in patterns if title is not None and p.lower() in title.lower())
        assert got[i] == ((hits[0][2], hits[0][3]) if hits else ("unmapped", None)), title
    with_empty = base.unionByName(spark.createDataFrame([("all", 99, 0, "")], base.schema))
    assert matching.map_first_substring(rows, with_empty).where("career_id = 'unmapped'").count() == 1


def test_every_label_pair_is_judged(spark):
    left = spark.createDataFrame([("Data Science",), ("data  science",), ("Java",)], "a string")
    right = spark.createDataFrame([("SCIENCE",), ("JAVA",), ("JAVA",)], "b string")
    rows = matching.judged_label_pairs(left, right, "a", "b").collect()
    assert len(rows) == 6
    assert {(r.a, r.b) for r in rows if r.matches} == {("Data Science", "SCIENCE"), ("data  science", "SCIENCE"), ("Java", "JAVA")}
