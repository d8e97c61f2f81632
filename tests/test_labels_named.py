"""Names found by the letters first are those found by the patterns alone."""

from pyspark.sql import functions as F

from hirelens.functions import labels


def test_named_equals_patterns(spark):
    names = list(labels.LABEL_SKILLS)
    rows = ["Go, c++ and JAVASCRIPT", "java8", "golang tcp/ip\nSQL", "", "İgit Kafka", "ſql", "正则表达式/数据清洗", None] + [f"x {n.upper()} y" for n in names]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    out = df.select(labels.named(F.col("t"), F.lower("t"), names).alias("a"), labels.hits(F.col("t"), [(n, labels._skill_pattern(n)) for n in names]).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in out) and sum(len(r["a"]) for r in out) >= len(names)


def test_letters_of_a_pattern():
    from hirelens.rules import tables
    asked = {p: labels.letters_of(p) for _, p in tables.SKILLS}
    # Patterns with more parts stay searched everywhere.
    assert sum(not c for c in asked.values()) == 2
    assert labels.letters_of(r"(?i)Stable\s*Diffusion|(?<![A-Za-z0-9_])(?:SDXL)(?![A-Za-z0-9_])") == ["diffusion", "sdxl"]
    assert labels.letters_of("(?i)HTML5?|CSS3?") == ["html", "css"] and labels.letters_of(r"C\+\+") == ["c++"]
    assert all(labels.letters_of(p) == [] for p in (r"\d+ab|cd", "(?:ab|cd)x", "a", "ab|", "ab{0,2}", "[ab]cd", "(?i)öl", r"\bab"))


def test_skills_equal_patterns(spark):
    from hirelens.rules import tables
    rows = ["", None, "javascript Java JavaScript2", "Stable  diffusion ＳＱＬ sql", "c++/C#/.net", "springboot spring-cloud REST api", "fine-tuning LORA", "python 9 requests", "TSX ts Kafka", "ſql İgit"] + [n for n, _ in tables.SKILLS]
    df = spark.createDataFrame([(r,) for r in rows], "job_description string")
    out = labels.tag_skills(df, columns=("job_description",)).select("skill_tags", labels.hits(F.coalesce("job_description", F.lit("")), tables.SKILLS).alias("b")).collect()
    assert all(r["skill_tags"] == r["b"] for r in out) and sum(len(r["b"]) for r in out) > 100
