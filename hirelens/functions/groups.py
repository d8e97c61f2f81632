"""Place, experience, size, education, employment type, date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.core import UNKNOWN, col, halfwidth, lookup, number_in, text, value

# Province names with the suffix of their full form, and their capitals.
SUFFIXES = {
    "市": "北京 天津 上海 重庆", "自治区": "内蒙古 西藏", "壮族自治区": "广西", "维吾尔自治区": "新疆",
    "回族自治区": "宁夏", "特别行政区": "香港 澳门",
    "省": "河北 山西 辽宁 吉林 黑龙江 江苏 浙江 安徽 福建 江西 山东 河南 湖北 湖南 广东 海南 四川 贵州 云南 陕西 甘肃 青海 台湾",
}
CAPITALS = (
    "河北:石家庄 山西:太原 辽宁:沈阳 吉林:长春 黑龙江:哈尔滨 江苏:南京 浙江:杭州 安徽:合肥 福建:福州 江西:南昌 山东:济南 河南:郑州 "
    "湖北:武汉 湖南:长沙 广东:广州 海南:海口 四川:成都 贵州:贵阳 云南:昆明 陕西:西安 甘肃:兰州 青海:西宁 台湾:台北 内蒙古:呼和浩特 "
    "西藏:拉萨 广西:南宁 新疆:乌鲁木齐 宁夏:银川"
)
EXPERIENCE_GROUPS = ["在校/应届", "1年以内", "1-3年", "3-5年", "5-10年", "10年以上", "经验不限", UNKNOWN]
SIZE_GROUPS = ["100人以下", "100-499人", "500-999人", "1000-9999人", "10000人及以上", UNKNOWN]
DEGREES = ["大专", "本科", "硕士", "博士"]
MANY, NATIONWIDE, ABROAD = "多省份", "全国/地点不限", "海外"


def city_name(c: str | Column = "city") -> Column:
    """First listed city without district and 市."""
    first = F.regexp_extract(text(c), r"^([^|、,，/]*)", 1)
    city = F.regexp_replace(F.regexp_extract(first, r"^([^-—·]*)", 1), "市$", "")
    return F.coalesce(F.nullif(city, F.lit("")), F.lit(UNKNOWN))


def default_cities() -> list[tuple[str, str]]:
    """Capitals and the provinces that are cities; pass a full gazetteer for other cities."""
    pairs = [p.split(":") for p in CAPITALS.split()]
    own = SUFFIXES["市"].split() + SUFFIXES["特别行政区"].split()
    return [(city, province) for province, city in pairs] + [(p, p) for p in own]


def province_name(df: DataFrame, columns: tuple[str, ...] = ("province", "city"), cities: DataFrame | None = None,
                  out: str = "province_group") -> DataFrame:
    """C4: province of the first resolvable place column; several provinces give 多省份.

    Place texts are resolved once per distinct text, then joined back, so the gazetteer
    work does not grow with the number of postings.
    """
    spark = df.sparkSession
    if cities is None:
        cities = lookup(spark, default_cities(), "city_key string, city_province string")
    full = [(name, name + suffix) for suffix, names in SUFFIXES.items() for name in names.split()]
    provinces = lookup(spark, full, "province_key string, full_name string")
    places = None
    for c in columns:
        one = df.select(F.trim(halfwidth(c)).alias("place"))
        places = one if places is None else places.unionByName(one)
    places = places.filter("place <> ''").distinct()
    part = F.explode(F.filter(F.split("place", r"[|、,，/\s]+"), lambda x: x != "")).alias("part")
    parts = places.select("place", part).withColumns({
        "_city": F.regexp_replace(F.regexp_extract("part", r"^([^-—·]*)", 1), "市$", ""),
        "_pre": F.regexp_extract("part", r"^(.+?)市", 1),
        "_full": F.coalesce(F.nullif(F.regexp_extract("part", r"^(.+?(?:壮族自治区|维吾尔自治区|回族自治区|自治区|特别行政区|省|市))", 1), F.lit("")),
                            F.col("part")),
    })
    known = provinces.select("full_name", F.col("province_key").alias("_by_full"))
    exact = provinces.select(F.col("province_key").alias("part"), F.col("province_key").alias("_by_name"))
    by_city = cities.select(F.col("city_key").alias("_city"), F.col("city_province").alias("_by_city"))
    by_pre = cities.select(F.col("city_key").alias("_pre"), F.col("city_province").alias("_by_pre"))
    solved = (
        parts.join(known, F.col("_full") == F.col("full_name"), "left").join(exact, "part", "left")
        .join(by_city, "_city", "left").join(by_pre, "_pre", "left")
        .withColumn("_p", F.coalesce(
            "_by_name", "_by_full", "_by_city", "_by_pre",
            F.when(F.col("part").isin("全国", "中国", "国内", "不限"), NATIONWIDE),
            F.when(F.col("part").rlike("^(海外|国外|境外)"), ABROAD), F.lit(UNKNOWN)))
        .groupBy("place").agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
        .select("place", F.when(F.col("_lo") != F.col("_hi"), MANY).otherwise(F.nullif("_lo", F.lit(UNKNOWN))).alias("_province"))
    )
    found = []
    for i, c in enumerate(columns):
        df = df.withColumn(f"_place{i}", F.trim(halfwidth(c))).join(
            solved.select(F.col("place").alias(f"_place{i}"), F.col("_province").alias(f"_found{i}")), f"_place{i}", "left")
        found.append(F.col(f"_found{i}"))
    drop = [f"_place{i}" for i in range(len(columns))] + [f"_found{i}" for i in range(len(columns))]
    return df.withColumn(out, F.coalesce(*found, F.lit(UNKNOWN))).drop(*drop)


def experience_group(c: str | Column = "experience") -> Column:
    """Eight experience buckets."""
    raw = F.trim(halfwidth(c))
    n = number_in(raw)
    return (
        F.when(raw.rlike("^(不限|经验不限|不限经验|无需经验|无经验要求|无工作经验|无经验)$"), "经验不限")
        .when(raw.rlike("应届|在校|学生|毕业生"), "在校/应届")
        .when(~raw.contains("年") | n.isNull() | (n > 60), UNKNOWN)
        .when(raw.rlike("以下|以内|不足|少于"), F.when(n <= 1, "1年以内").otherwise(UNKNOWN))
        .when(n < 1, "1年以内").when(n < 3, "1-3年").when(n < 5, "3-5年").when(n < 10, "5-10年").otherwise("10年以上"))


def company_size_group(c: str | Column = "company_size") -> Column:
    """Six company size buckets."""
    raw = F.replace(F.trim(halfwidth(c)), F.lit(","), F.lit(""))
    n = number_in(raw) * F.when(raw.contains("万"), 10000.0).otherwise(1.0)
    return (
        F.when(~raw.contains("人") | n.isNull(), UNKNOWN)
        .when(raw.rlike("以下|少于|小于|不足"), F.when(n <= 100, "100人以下").otherwise(UNKNOWN))
        .when(n < 100, "100人以下").when(n < 500, "100-499人").when(n < 1000, "500-999人")
        .when(n < 10000, "1000-9999人").otherwise("10000人及以上"))


def education_group(c: str | Column = "education") -> Column:
    """Ladder for charts; texts outside it stay as they are."""
    raw = F.trim(halfwidth(c))
    return (
        F.when(raw.rlike(r"^\d*$"), UNKNOWN).when(raw.rlike("不限|无学历要求"), "学历不限").when(raw.rlike("中专|中技"), "中专/中技")
        .when(raw.contains("博士"), "博士").when(raw.rlike("硕士|研究生"), "硕士").when(raw.contains("本科"), "本科")
        .when(raw.rlike("大专|专科"), "大专").otherwise(raw))


def canonical_education(c: str | Column = "education") -> Column:
    """Ladder for admission, lowest named degree wins."""
    raw = F.coalesce(col(c), F.lit(""))
    out = F.when(raw.rlike("不限|不要求|无要求"), "不限")
    for degree in DEGREES:
        out = out.when(raw.contains(degree), degree)
    return out.when(raw.contains("研究生"), "硕士").otherwise(UNKNOWN)


def employment_type(c: str | Column = "employment_type") -> Column:
    """From the field alone."""
    raw = text(c)
    return (F.when(raw.contains("实习"), "实习").when(raw.rlike("兼职|临时|小时|日结"), "兼职/临时")
            .when(raw.rlike("全职|社会招聘|校园招聘"), "全职").otherwise(UNKNOWN))


def employment_type_in_context(field: str = "employment_type", title: str = "job_name", body: str = "job_description",
                               platform: str = "platform") -> Column:
    """From the field, title and body together."""
    whole = F.concat_ws("\n", text(field), text(title), text(body))
    return (F.when(whole.rlike("兼职|临时|众包|灵活用工|接单"), "兼职/临时").when(whole.contains("实习") | (F.col(platform) == "实习僧"), "实习")
            .when(whole.rlike("校园|校招|应届招聘"), "校园招聘").when(whole.rlike("全职|社会招聘|社招"), "全职").otherwise(UNKNOWN))


def observation_date(*columns: str | Column) -> Column:
    """Spreadsheet serial or written date; written dates need a year 20xx."""
    raw = F.coalesce(*[value(c) for c in columns])
    serial = raw.try_cast("double")
    written = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "[年月]", "-"), "日", ""), "/", "-")
    day = F.regexp_extract(written, r"(20\d{2}-\d{1,2}-\d{1,2})", 1)
    return F.coalesce(
        F.when((serial > 40000) & (serial < 80000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))),
        F.when(raw.rlike(r"20\d\d"), F.nullif(day, F.lit("")).try_cast("date")))
