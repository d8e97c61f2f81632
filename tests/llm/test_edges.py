"""Every operator and stage on awkward and on empty tables."""

import collections

import pytest

import corpus_pipeline
from hirelens.llm import language, licences, minhash, mixing, packing, quality, search, tokens, wrappers
from hirelens.llm.embeddings import near_embeddings
from hirelens.llm.queries import WORD_BPE
from tests.llm.edge import documents

ROWWISE = {
    "tokens": lambda d: tokens.count_tokens(d, WORD_BPE), "language": language.identify_language, "quality": quality.classify_quality,
    "minhash": minhash.near_duplicates, "mixing": mixing.mix_documents}


@pytest.mark.parametrize("name", ROWWISE)
def test_a_row_for_each_row(spark, name):
    docs = documents(spark)
    ids = collections.Counter(r[0] for r in docs.select("doc_id").collect())
    assert collections.Counter(r["doc_id"] for r in ROWWISE[name](docs).collect()) == ids


@pytest.mark.parametrize("name", [*ROWWISE, "packing", "licences", "search"])
def test_empty_table(spark, name):
    docs = documents(spark, [])
    run = {**ROWWISE, "packing": lambda d: packing.pack(d, WORD_BPE), "licences": licences.scan_licences, "search": lambda d: search.top_k(d, d)}[name]
    assert run(docs).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, name, stage):
    docs = documents(spark)
    out = stage(spark, docs, "")
    if stage is not corpus_pipeline.packing:
        assert out.columns == docs.columns
        rows = [r.asDict() for r in out.collect()]
        assert all(r["topic"] == "q" and r["tokens"] == 5 and r["kept"] is True for r in rows)
    else:
        assert out.count() >= docs.count()
    empty = stage(spark, documents(spark, []), "")
    assert empty.collect() == []


def test_defined_results(spark):
    docs = documents(spark)
    near = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert near[0]["n_shingles"] == near[1]["n_shingles"] == near[2]["n_shingles"] == 0 and near[2]["component_id"] == 2
    assert near[9]["component_id"] == 8 and not near[9]["kept"] and near[8]["kept"]
    assert near[None]["kept"] and near[None]["component_id"] is None
    said = {r["doc_id"]: r for r in language.identify_language(docs).collect()}
    assert all(said[i]["lang_pred"] == "und" and said[i]["score"] == 0 for i in (0, 1, 2))
    good = {r["doc_id"]: r for r in quality.classify_quality(docs).collect()}
    assert all(good[i]["score"] == 0 and not good[i]["kept"] for i in (0, 1, 2))
    count = {r["doc_id"]: r for r in tokens.count_tokens(docs, WORD_BPE).collect()}
    assert count[0]["n_tokens"] == count[0]["n_bytes"] == 0 and count[7]["over_limit"]
    packed = [r for r in packing.pack(docs, WORD_BPE).collect() if r["doc_id"] in (0, 1, 2)]
    assert [r["length"] for r in packed] == [1, 1, 1]


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (1, [2.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None), (5, None, "a"), (6, [], "a"), (7, [0.0, 0.0], "a"),
            (8, [nan, 1.0], "a"), (9, [inf, 1.0], "a"), (10, [None, 1.0], "a"), (11, [1.0, 0.0, 0.0], "a"), (12, [-1.0, 0.0], "a"), (None, [1.0, 0.0], "a"), (1, [2.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").selectExpr("*", "1 AS rep", "2 AS m", "3 AS leaves", "4 AS v", "5 AS dim")
    out = collections.defaultdict(list)
    for r in near_embeddings(df).collect():
        out[r["vec_id"]].append((r["n_links"], r["component_id"], r["kept"]))
    assert out[0] == [(3, 0, True)] and out[1] == [(3, 0, False)] * 2 and out[2] == [(3, 0, False)]
    assert all(out[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12)) and out[None] == [(0, None, True)]
    assert near_embeddings(df.limit(0)).collect() == []


def test_pages(spark):
    rows = [(0, "https://h.example/a", None), (1, "https://h.example/b", ""), (2, None, "<p>x &amp; y</p>"), (None, "no host", "plain < text"), (4, "https://h.example/c", "<p>unclosed <b>bold"), (4, "https://h.example/c", "<p>unclosed <b>bold")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "'w' AS wrapper", "'o' AS host")
    out = sorted((r["page_id"] if r["page_id"] is not None else -1, r["text"], r["n_chars"]) for r in wrappers.extract_main_text(df).collect())
    assert [x[:2] for x in out if x[0] in (0, 1)] == [(0, ""), (1, "")] and out[-1][1] == "unclosed bold" and len(out) == 6
    assert all(n == len(t) for _, t, n in out)
    assert wrappers.extract_main_text(df.limit(0)).collect() == []


def test_search_and_licences(spark):
    docs = documents(spark)
    hits = [r for r in search.top_k(docs, docs.filter("doc_id = 8"), k=2).collect()]
    assert [(r["rank"], r["doc_id"]) for r in sorted(hits, key=lambda r: r["rank"])] == [(1, 8), (2, 9)]
    assert licences.scan_licences(docs).collect() == []


def test_deeply_nested_pages(spark):
    deep = "<div>" * 5000 + "<p>deep {0}</p>" + "</div>" * 5000 + "<nav>" * 1200 + "menu"
    rows = [(i, "https://deep.example/", "<article>" + deep.format(i) + "</article>") for i in range(2)] + [(i, "https://plain.example/", deep.format(i)) for i in (2, 3)]
    out = {r["page_id"]: r["text"] for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"deep {i}" for i in range(4)}
    shape = wrappers.fold(wrappers.parse(deep + "<ul>" + "<li>x</li>" * 3 + "</ul>")[1])[0]
    assert wrappers.dumps(wrappers.loads(wrappers.dumps(shape))) == wrappers.dumps(shape)
