"""Operators against brute force, the tokenizer, planted cases and SQL on the small tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from hirelens.llm import embeddings, language, licences, minhash, packing, pretokens, quality, search, wrappers
from hirelens.llm.queries import QUERIES, SQL, WORD_BPE
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_BPE)


def shingles(text, k):
    w = SPACE.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_groups(texts, k):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids = sorted(sets)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b]))
              and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, groups(ids, linked)


def test_token_counts(spark, docs, tokenizer):
    out = {r["doc_id"]: r for r in QUERIES["op1_token_counts"](spark, SF).collect()}
    for i, d in docs.items():
        n = len(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids)
        assert (out[i]["n_bytes"], out[i]["n_tokens"], out[i]["over_limit"]) == (len((d["text"] or "").encode()), n, n > 2048)


def test_rare_pre_tokens_take_the_join(spark, docs, tokenizer):
    from hirelens.llm.tokens import count_tokens
    table = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r["n_tokens"] for r in count_tokens(table, WORD_BPE, hot=5).collect()}
    assert out == {i: len(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids) for i, d in docs.items()}


def test_ids_equal_the_tokenizer(tokenizer):
    draw = np.random.default_rng(3)
    texts = ["it's we're I'll don't 'sx ''s x'dd they've 12 3a4 '", None, "<|endoftext|> a<|startoftext|>b's", "<|ENDOFTEXT|> İstanbul ΑΣ ς", "ＡＢＣ 漢字 é \x85\xa0x", "²³¼ ªº µ ÿŸ"]
    texts += ["".join(draw.choice(list("abst'lrevdm 1.,!éÉ\n|²<>"), int(draw.integers(0, 60)))) for _ in range(400)]
    table, got = pretokens.PieceTable(tokenizer), []
    for _, rows, ids, ends in pretokens.id_slices(pa.array(texts), tokenizer, table):
        got += [ids[ends[i]:ends[i + 1]].tolist() for i in range(rows)]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing(spark, docs, tokenizer):
    out = QUERIES["op3_best_fit_packing"](spark, SF).collect()
    want = {}
    for i, d in docs.items():
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[i, k] = (at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == want
    rows = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == rows.get(r["sequence_id"], 0)
        rows[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(rows.values()) <= 4096 and len(rows) <= math.ceil(sum(rows.values()) / 4096) + 2


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_once(seed):
    draw = np.random.default_rng(seed)
    histogram = {int(k): int(n) for k, n in zip(draw.choice(4096, 300, replace=False) + 1, draw.integers(1, 50, 300))}
    plan = packing.solve_configurations(histogram, 4096, rounds=200)
    held = Counter()
    for config, n in plan:
        assert sum(config) <= 4096
        for length in config:
            held[length] += n
    assert held == histogram
    assert sum(n for _, n in plan) <= 1.01 * sum(n for _, n in packing.best_fit(histogram, 4096)) + 1


def test_language_held_out(spark, docs):
    out = QUERIES["op4_language_id"](spark, SF).collect()
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_filter_drops_noise_and_keeps_clean_texts(spark, docs):
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    rng = random.Random(3)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(words)) for words in (4, 20, 200, 5000) for _ in range(5)]
    noise += ["\u4e00\u9fa5\u7684\u662f" * 50, "\u0416\u0449\u044b\u0434 " * 30]
    other = [(None,), ("",), ("12 34",)]
    rows = [(-1 - i, t) for i, t in enumerate(noise)] + [(-1000 - i, *t) for i, t in enumerate(other)] + [(i, r["text"]) for i, r in docs.items()]
    kept = language.keep_languages(spark.createDataFrame(rows, "doc_id long, text string"), model)
    clean = {i for i, r in docs.items() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert {r["doc_id"] for r in kept.collect()} == clean
    only = language.keep_languages(spark.createDataFrame(rows, "doc_id long, text string"), model, languages=("fr",))
    assert 0 < only.count() < len(clean)


def test_mixing_equals_sql(spark):
    assert compare(spark, connect(SF), QUERIES["op5_mix_sources"], SQL["op5_mix_sources"], SF) is None


def test_mixing_meets_its_margins(spark):
    rows = [(r["source"], r["lang"], r["topic"], r["tokens"], r["ratio"]) for r in QUERIES["op5_mix_sources"](spark, SF).collect()]
    mass, fitted = Counter(), Counter()
    for source, _, _, tokens, ratio in rows:
        mass[source] += tokens
        fitted[source] += tokens * ratio
    power = {s: m ** 0.5 for s, m in mass.items()}
    for s in mass:
        assert fitted[s] == pytest.approx(power[s] / sum(power.values()) * sum(mass.values()), rel=0.02)


def test_rows_of_the_mixture_stage_meet_the_margins(spark):
    # A source with over a third of the tokens, small ones beside it, languages across.
    docs = spark.range(6000).selectExpr("id AS doc_id", "array_join(transform(sequence(0, id % 5 + 7), x -> concat('w', x)), ' ') AS text",
                                        "CASE WHEN id % 10 < 4 THEN 'hot' ELSE concat('s', pmod(xxhash64(id), 12)) END AS source", "if(id % 7 = 0, 'de', 'en') AS lang")
    mass, drawn, power = ({"source": Counter(), "lang": Counter()} for _ in range(3))
    for rows, into in ((docs, mass), (corpus_pipeline.mixture(spark, docs, ""), drawn)):
        for r in rows.collect():
            for m in into:
                into[m][r[m]] += len(r["text"].split())
    for m in mass:
        whole = sum(x ** 0.5 for x in mass[m].values())
        for value, x in mass[m].items():
            assert drawn[m][value] / sum(drawn[m].values()) == pytest.approx(x ** 0.5 / whole, rel=0.08)
    assert sum(drawn["source"].values()) == pytest.approx(sum(mass["source"].values()), rel=0.04)


def test_near_duplicates(spark, docs):
    sets, root = near_groups({i: d["text"] for i, d in docs.items()}, 4)
    out = QUERIES["op6_minhash_near_dedup"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == {i: (len(sets[i]), root[i], root[i] == i) for i in docs}


def test_large_group_with_far_members(spark):
    draw = np.random.default_rng(1)
    base = [f"w{i}" for i in draw.integers(0, 5000, 120)]
    texts = {}
    for i in range(150):
        w = list(base)
        for at in draw.choice(120, int(draw.integers(0, 8)), replace=False):
            w[at] = f"x{draw.integers(0, 10**6)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _, root = near_groups(texts, 4)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == root


def test_licences(spark, docs):
    marks = {"apache-2.0": "Apache License, Version 2", "mit": "MIT License", "gpl-3.0": "GNU General Public License, version 3", "cc-by-nc": "CC BY-NC 4"}
    want = {(i, k): f for i, d in docs.items() for k, line in enumerate((d["text"] or "").split("\n")) for f, m in marks.items() if m in line}
    found = {(r["doc_id"], r["paragraph"]): r["family"] for r in QUERIES["op7_license_scan"](spark, SF).collect()}
    assert {k: f for k, f in found.items() if f != "unknown"} == want


def test_wrapped_and_short_licence_notices(spark):
    mit = ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal", "in the Software without restriction, including without limitation the rights"]
    bsd = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met:"]
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    texts = {
        1: ["MIT License", "", *mit], 2: ["/*", *(f" * {x}" for x in bsd), " */", "int main() {"], 3: ["x = 1", *(f"# {x}" for x in gpl), "y = 2"],
        4: ["// SPDX-License-Identifier: MIT", "#include <stdio.h>"], 5: ["# SPDX-License-Identifier: Zlib", "pass"], 6: ["Licensed under the Apache License, Version 2.0.", "Licensed under the MIT License."],
        7: ["prose before it goes on", *gpl, *mit, "and prose behind it"], 8: ["dnl SPDX-License-Identifier: Apache-2.0"], 9: ["He gave no permission to copy", "the keys of his car."]}
    want = {1: {0: "mit", 2: "mit"}, 2: {1: "bsd"}, 3: {1: "gpl-3.0"}, 4: {0: "mit"}, 5: {}, 6: {0: "apache-2.0", 1: "mit"}, 7: {1: "gpl-3.0", 5: "mit"}, 8: {0: "apache-2.0"}, 9: {}}
    plain = [(100 + i, f"Some line number {i} of other words that tells of no such thing at all.") for i in range(50)]
    rows = licences.scan_licences(spark.createDataFrame([*((k, "\n".join(t)) for k, t in texts.items()), *plain], "doc_id long, text string")).collect()
    found = {k: {} for k in texts}
    for r in rows:
        if r["confirmed"]:
            assert r["paragraph"] not in found[r["doc_id"]]
            found[r["doc_id"]][r["paragraph"]] = r["family"]
    assert found == want


def test_every_template_has_a_cue():
    from hirelens.llm.licences import CUE, TEMPLATES
    assert all(re.search(CUE, t) for _, t in TEMPLATES)


def test_search(spark, docs):
    word = re.compile("[0-9a-z\u0080-\U0010ffff]+")
    terms = {i: Counter(word.findall((d["text"] or "").translate(LOWER))) for i, d in docs.items()}
    size = {i: sum(c.values()) for i, c in terms.items()}
    mean, df = sum(size.values()) / len(size), Counter(t for c in terms.values() for t in c)
    found = {}
    for r in QUERIES["op8_exact_top_k_search"](spark, SF).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["doc_id"], r["score"])
    for q in (i for i in docs if i % 50 == 0):
        score = Counter()
        for t, k in terms[q].items():
            for i in docs:
                if n := terms[i].get(t):
                    score[i] += k * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[i] / mean))
        best = sorted(score.items(), key=lambda x: (-round(x[1], 8), x[0]))[:10]
        assert [found[q][k + 1][0] for k in range(len(best))] == [i for i, _ in best]
        assert [found[q][k + 1][1] for k in range(len(best))] == pytest.approx([s for _, s in best])


def test_search_in_many_shards_and_blocks(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    some = table.filter("doc_id % 20 = 0")
    key = lambda rows: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 8)) for r in rows)
    assert key(search.top_k(table, some, k=5, block_queries=3).collect()) == key(search.top_k(table.coalesce(1), some, k=5).collect())


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = {r["doc_id"]: r["kept"] for r in quality.classify_quality(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    good, bad = [i for i in truth if truth[i] == 1], [i for i in truth if truth[i] == 0]
    assert sum(out[i] for i in good) >= 0.99 * len(good) and sum(not out[i] for i in bad) >= 0.85 * len(bad)


def test_label_model_learns_who_is_right():
    draw = np.random.default_rng(5)
    truth = draw.random(4000) < 0.8
    votes = np.zeros((4000, 5), int)
    for k, (sees, wrong) in enumerate([(0.9, 0.02), (0.5, 0.01), (0.4, 0.02), (0.3, 0.3), (0.6, 0.05)]):
        bad = np.where(truth, draw.random(4000) < wrong, draw.random(4000) < sees)
        votes[:, k] = np.where(bad, -1, 1)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    chance, posterior = quality.fit_labellers(patterns, counts)
    assert ((posterior[where.ravel()] > 0.5) == truth).mean() > 0.95
    assert chance[0, 0, 0] > 0.8 and chance[3, 0, 0] < 0.5


def test_embeddings_against_brute_force(spark):
    draw = np.random.default_rng(2)
    centres = draw.standard_normal((30, 32))
    x = np.concatenate([draw.standard_normal((500, 32)), *(c + 0.12 * draw.standard_normal((int(k), 32)) for c, k in zip(centres, draw.integers(2, 60, 30)))])
    label = draw.integers(0, 3, len(x))
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = (u @ u.T >= 0.93) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    root = groups(range(len(x)), zip(*map(lambda a: a.tolist(), np.nonzero(np.triu(close)))))
    for options in ({}, {"leaf_rows": 40, "block": 16}):
        out = embeddings.near_embeddings(df, **options).collect()
        found = sum(r["n_links"] for r in out)
        assert 0.999 * close.sum() <= found <= close.sum()
        assert sum(r["component_id"] == root[r["vec_id"]] for r in out) >= 0.999 * len(x)


def test_embeddings_stay_off_the_driver_and_lose_no_pair(spark, monkeypatch):
    x = np.random.default_rng(4).standard_normal((700, 12))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = (u @ u.T >= 0.8) & ~np.eye(len(x), dtype=bool)

    def refused(*_):
        raise AssertionError("vectors on the driver")

    monkeypatch.setattr(type(df), "toArrow", refused)
    for options in ({}, {"leaf_rows": 7, "block": 100}):
        out = {r["vec_id"]: r["n_links"] for r in embeddings.near_embeddings(df, threshold=0.8, **options).collect()}
        assert [out[i] for i in range(len(x))] == close.sum(axis=1).tolist() and close.any()


def test_pages_of_the_table(spark):
    import html
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op10_html_extraction"](spark, SF).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<(/?)(p|h1|br)\b[^>]*>", " ", body))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_wrapper_without_a_marked_article():
    page = """<html><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><div id="content"><h2>Title %s</h2><p>Long text %s <a href=x>link</a> tail<br>next</p>
    <ul><li>i1<li>i2 %s</ul><p>two %s</div><div class=sidebar>side %s</div><form>f</form><div class="comments"><article class="comment">c %s</article></div><div><a href=y>More %s</a></div><footer>ft</footer>"""
    shapes = [wrappers.fold(wrappers.parse(page % ((k,) * 7))[1])[0] for k in "abc"]
    whole = wrappers.align(wrappers.align(shapes[0], shapes[1]), shapes[2])
    assert wrappers.read(page % (("a",) * 7), whole, False) == "Title a Long text a link tail next i1 i2 a two a"


def test_pages_without_a_mark_beside_marked_pages(spark):
    plain = "<body><div>Site name</div><div><h2>Title %s</h2><p>Long text %s</p></div></body>"
    rows = [(k, f"https://h.example/{k}", plain % (k, k)) for k in range(4)] + [(4, "https://h.example/4", "<body><div>Site name</div><article><p>Marked</p></article></body>")]
    rows += [(k + 10, url, page) for url in (None, "/relative") for k, _, page in rows]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all(r["text"] == ("Marked" if r["page_id"] % 10 == 4 else f"Title {r['page_id'] % 10} Long text {r['page_id'] % 10}") for r in wrappers.extract_main_text(df).collect())


def test_text_that_only_one_page_has_is_kept(spark):
    frame = "<body><div>Site name</div><div id=c><h2>Title %s</h2><p>Text %s</p>%s</div></body>"
    extra = ["", "<blockquote>Said once</blockquote>", "<table><tr><td>Cell once</table><h3>Below once</h3>", "", ""]
    pages = [frame % (k, k, x) for k, x in enumerate(extra)] + ["<body><div>Site name</div><section><h4>Own layout</h4><pre>All of it</pre></section></body>"]
    want = [f"Title {k} Text {k}{x}" for k, x in enumerate(["", " Said once", " Cell once Below once", "", ""])] + ["Own layout All of it"]
    # Copies of a page do not make its text the host's; neither order of pages nor tasks matter.
    rows = [(k % 6, f"https://h.example/{k}", pages[k % 6]) for k in (5, 0, 1, 2, 3, 4, 1, 2, 5)]
    for order in (rows, rows[::-1]):
        out = wrappers.extract_main_text(spark.createDataFrame(order, "page_id long, url string, html string")).collect()
        assert [(r["page_id"], r["text"]) for r in out if r["text"] != want[r["page_id"]]] == []


def test_two_layouts_share_only_what_both_pages_have():
    one, two = ("<body><div>Site</div>%s</body>" % x for x in ("<blockquote>First</blockquote>", "<section>Second</section>"))
    whole = wrappers.align(*(wrappers.fold(wrappers.parse(p)[1])[0] for p in (one, two)))
    assert [wrappers.read(p, whole, not wrappers.varies(whole)) for p in (one, two)] == ["First", "Second"]


def test_wrappers_find_options_and_repeats():
    one, two = (wrappers.fold(wrappers.parse(p)[1])[0] for p in ("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p></div>", "<div><h2>e</h2><p>f</p><table><tr><td>g</table></div>"))
    whole = wrappers.align(one, two)
    assert [(x[0], x[1]) for x in whole[0][2]] == [("(h2|p)", "+"), ("table", "?")]


def test_pipeline_against_its_operators(spark, docs):
    seen, current = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        current = spark.createDataFrame(stage(spark, current, SF).toArrow())
        seen[name] = current
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in seen.items()}
    good = {r["doc_id"] for r in quality.classify_quality(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r["kept"]}
    assert ids["quality classifier"] == good and ids["language ID"] <= good
    left = {i: docs[i]["text"] for i in ids["language ID"]}
    _, root = near_groups(left, 5)
    assert ids["MinHash near-dedup"] == {i for i in left if root[i] == i}
    assert ids["best-fit packing"] == ids["mixing sources"] <= ids["MinHash near-dedup"]
    whole = entry.queries()["pipeline"](spark, SF)
    assert {r["doc_id"] for r in whole.collect()} == ids["best-fit packing"] and whole.columns == seen["best-fit packing"].columns
