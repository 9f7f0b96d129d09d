"""The training-data operators on small tables: defined results for odd input, and brute force."""

import hashlib
import itertools
import re

import numpy as np
import pytest

from netloom.llm import components, decontaminate, exact_dedup, isotonic, licenses, linkage, near_dedup, packing, pii, quality, shingles, substring_dedup, toxicity, urls

LONG = " ".join(f"word{i}" for i in range(60))
ODD = [(1, None), (2, ""), (3, "one two"), (4, LONG), (5, LONG + "  "), (5, LONG + "  "), (None, LONG), (6, "x" * 50_000), (7, "ab\n" * 3000), (8, LONG.replace("word7 ", "other "))]
ALL = (toxicity, quality, exact_dedup, near_dedup, packing, licenses, pii, substring_dedup, decontaminate)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "z", 0.5) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score double")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(10, 40))), (2, None), (3, "")], "item_id long, text string")


def apply(op, docs, labels, benchmark):
    if op in (toxicity, quality):
        return op.score(docs, op.fit(docs, labels))
    f = {exact_dedup: exact_dedup.decide, near_dedup: near_dedup.decide, packing: packing.pack, licenses: licenses.scan, pii: pii.report, substring_dedup: substring_dedup.removals, decontaminate: lambda d: decontaminate.search(d, benchmark)}[op]
    return f(docs)


@pytest.mark.parametrize("op", ALL, ids=lambda m: m.__name__.rsplit(".", 1)[-1])
def test_odd_and_empty_tables(op, odd, empty, labels, benchmark):
    rows = apply(op, odd, labels, benchmark).collect()
    if op not in (substring_dedup, decontaminate):
        assert len(rows) == len(ODD)
    assert apply(op, empty, labels.where("false"), benchmark.where("false")).collect() == []


def test_no_labels(odd, labels):
    for op in (toxicity, quality):
        assert {r.score for r in op.score(odd, op.fit(odd, labels.where("false"))).collect()} == {0.5}
    assert quality.keep(odd, quality.fit(odd, labels.where("false"))).columns == odd.columns


def test_exact_dedup_over_batches(spark, odd):
    docs = spark.createDataFrame([(i, f"a{i % 7}\t b") for i in range(100)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in exact_dedup.decide(docs, files_per_batch=1).collect()}
    assert all(got[i].keep_id == i % 7 and got[i].kept == (i < 7) and got[i].group_size == len(range(i % 7, 100, 7)) for i in range(100))
    assert got[3].text_sha256 == hashlib.sha256(b"a3 b").hexdigest()
    kept = exact_dedup.keep(odd)
    assert kept.columns == odd.columns and {1, 3, 4, 6, 7, 8} <= {r.doc_id for r in kept.collect()}


def jaccard_sets(texts):
    out = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def test_near_dedup_brute_force(spark):
    r = np.random.default_rng(3)
    texts = {}
    for g in range(6):  # groups of edited copies around the threshold, sharing one passage
        base = [f"b{g}w{i}" for i in range(80)] + [f"c{i}" for i in range(60)]
        for k in range(15):
            w = list(base)
            for at in r.integers(0, len(w), r.integers(0, 7)):
                w[at] = f"e{g}x{k}y{at}"
            texts[100 * g + k] = " ".join(w)
    texts |= {900: "", 901: "short text", 902: "Short  text", 903: None}
    sets = jaccard_sets(texts)
    root = {d: d for d in texts}
    find = lambda d: d if root[d] == d else find(root[d])
    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = near_dedup.decide(docs).collect()
    assert {g.doc_id: g.component_id for g in got} == {d: find(d) for d in texts}
    assert {g.doc_id: g.n_shingles for g in got} == {d: len(s) for d, s in sets.items()}


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (200, 201)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[201] == 200


def test_substring_dedup_finds_planted_passages(spark):
    r = np.random.default_rng(5)
    own = lambda n: " ".join(f"u{x}" for x in r.integers(0, 10**9, n))
    passage = own(70)
    near = passage.replace(passage.split()[30], "changed")
    docs = spark.createDataFrame([(i, own(40) + "\n" + (passage if i < 5 else near if i == 5 else own(60)) + "\nend") for i in range(12)], "doc_id long, text string")
    got = substring_dedup.removals(docs).collect()
    assert {g.doc_id for g in got} == {1, 2, 3, 4, 5} and {g.keep_doc_id for g in got} == {0} and {g.line for g in got} == {1}
    t = {d.doc_id: d.text for d in docs.collect()}
    assert all(t[g.doc_id][g.start : g.end] in (passage, near) for g in got)
    bands, rows = substring_dedup.tune()
    assert 1 - (1 - 0.75**rows) ** bands >= substring_dedup.RECALL


def test_substring_dedup_finds_passages_inside_and_across_lines(spark):
    r = np.random.default_rng(6)
    own = lambda n: [f"u{x}" for x in r.integers(0, 10**9, n)]
    for n in (50, 80):
        passage = own(n)
        wrapped = [passage[i : i + 9] for i in range(0, n, 9)]
        texts = [" ".join(own(300) + passage + own(300)), " ".join(own(400) + passage + own(90)), " ".join(own(12)) + "\n" + "\n".join(map(" ".join, wrapped)) + "\n" + " ".join(own(12)), " ".join(own(600))]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = substring_dedup.removals(docs).collect()
        assert {(g.doc_id, g.keep_doc_id) for g in got} == {(1, 0), (2, 0)}
        for g in got:
            w = texts[g.doc_id][g.start : g.end].split()
            assert len(w) >= substring_dedup.UNIT and " ".join(w) in " ".join(passage)
    # repeats inside one text stay once, also where they touch
    period = own(7)
    docs = spark.createDataFrame([(1, " ".join(period * 40))], "doc_id long, text string")
    got = substring_dedup.removals(docs).collect()
    assert got and all(g.start > 0 and g.doc_id == g.keep_doc_id for g in got)
    # across documents only: own repeats stay, and so does a shared run too short to hold a unit
    short = own(substring_dedup.UNIT - 1)
    texts = [" ".join(period * 40), " ".join(own(90) + short + own(90)), " ".join(own(70) + short + own(100)), " ".join(own(60) + passage), " ".join(passage + own(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring_dedup.removals(docs, within=False).collect()
    assert {(g.doc_id, g.keep_doc_id) for g in got} == {(4, 3)}


def test_wand_returns_all_above_threshold():
    r = np.random.default_rng(2)
    items = [(i, " ".join(f"t{x}" for x in r.zipf(1.5, r.integers(5, 30)) % 200)) for i in range(150)]
    index = decontaminate.build(items, blocks=8)[0]
    for _ in range(60):
        i = int(r.integers(150))
        w = decontaminate.words(items[i][1])[: int(r.integers(1, 30))] + [f"t{x}" for x in r.zipf(1.5, 10) % 200]
        terms = np.unique([index.vocabulary[x] for x in w if x in index.vocabulary])
        want = {}
        for t in terms:
            for item, v in index.postings[t]:
                want[item] = want.get(item, 0) + v
        got = dict(index.search(terms, 0.4))
        assert set(got) == {k for k, v in want.items() if v >= 0.4 - 1e-9} and all(np.isclose(got[k], want[k]) for k in got)


def test_decontamination_and_clean_documents(spark, benchmark):
    item = " ".join(f"word{i}" for i in range(10, 40))
    docs = spark.createDataFrame([(1, "a b c " * 50 + item + " d e f" * 50), (2, "a b c " * 100), (3, item.upper()), (4, " ".join(item.split()[::-1]))], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.search(docs, benchmark).collect()} == {(1, 1), (3, 1)}
    assert {r.doc_id for r in decontaminate.keep(docs, benchmark).collect()} == {2, 4}


def test_decontamination_of_long_items(spark):
    r = np.random.default_rng(8)
    texts = [" ".join(f"v{x}" for x in r.integers(0, 3000, n)) for n in (300, 65, 130, 300)]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    other = lambda n: " ".join(f"z{x}" for x in r.integers(0, 3000, n))
    docs = [(i, f"{other(77 + i)} {t} {other(150)}") for i, t in enumerate(texts)]
    docs += [(10, other(50) + " " + " ".join(texts[0].split()[:100]) + " " + other(50)), (11, " ".join(texts[0].split()[::-1])), (12, other(700))]
    got = decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(g.doc_id, g.item_id) for g in got} == {(i, i) for i in range(4)}
    assert all(g.question >= 0.9 and g.answer >= 0.9 for g in got)


def test_packing_is_optimal_and_whole(spark):
    r = np.random.default_rng(0)
    for _ in range(20):
        lengths = np.sort(r.choice(50, 7, replace=False)) + 1
        counts = r.integers(1, 9, 7)
        cost = lambda cuts: sum(c * (min(b for b in cuts if b >= x) - x) for x, c in zip(lengths, counts))
        want = min(cost([*map(int, c), int(lengths[-1])]) for n in range(3) for c in itertools.combinations(lengths[:-1], n))
        plan = packing.boundaries(lengths, counts, 3)
        assert plan.padding == want == cost(plan.bounds)
    docs = spark.createDataFrame([(i, "x" * (i % 400)) for i in range(2000)], "doc_id long, text string")
    p = packing.pack(docs, 4, 500).toPandas()
    g = p.groupby(["bucket", "batch"]).agg(n=("doc_id", "size"), b=("boundary", "first"), last=("place", "max"))
    assert sorted(p.doc_id) == list(range(2000)) and (p.length <= p.boundary).all() and (g.n * g.b <= 500).all() and (g["last"] == g.n - 1).all()


def test_packing_starts_no_python_workers(spark):
    docs = spark.range(50).selectExpr("id as doc_id", "repeat('x', cast(id % 40 as int)) as text")
    assert "ExistingRDD" not in packing.pack(docs)._jdf.queryExecution().toString()  # an RDD of a list is made by Python workers


def test_exact_join_needs_one_python_worker_a_task(spark, monkeypatch):
    base = [f"w{i}" for i in range(80)]
    docs = spark.createDataFrame([(k, " ".join(base[:40] + [f"x{k}"] * (k > 0) + base[40:])) for k in range(4)], "doc_id long, text string")
    got, plans, cut = {}, [], linkage.cut
    monkeypatch.setattr(near_dedup, "link", lambda *a: got.update(sets=a[3]) or linkage.link(*a))
    near_dedup.decide(docs).collect()
    monkeypatch.setattr(linkage, "cut", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))) or cut(df, name))
    members = spark.range(4).selectExpr("id", "id as c")
    pairs = linkage._full_join(members.selectExpr("id as b", "c as c_b"), members, got["sets"], 75)
    assert {(r.a, r.b) for r in pairs.collect()} == set(itertools.combinations(range(4), 2))
    assert dict(plans)["elements"] == 1 and max(n for _, n in plans) == 1


def test_license_join_matches_brute_force():
    idx = licenses.index({"the": 1000, "license": 5, "of": 900})
    r = np.random.default_rng(4)
    hits = 0
    for _ in range(300):
        text = licenses.TEMPLATES[int(r.integers(len(licenses.TEMPLATES)))][1]
        found = ["other"] * int(r.integers(0, 9)) + [x for x in licenses.words(text) if r.random() < 0.9] + ["other", "nc", "the"] * int(r.integers(0, 3)) + licenses.words(licenses.TEMPLATES[int(r.integers(15))][1])
        want = {}
        for k, t in enumerate(idx.templates):
            for i, x in enumerate(found):
                block = set(found[i : i + t.size])
                if x in t.tokens and len(block & set(t.tokens)) >= t.need and t.must <= block and not t.without & block:
                    want[k] = max(want.get(k, 0), len(block & set(t.tokens)) / len(t.tokens))
        got = {}
        for k, _, _, share in idx.search(found):
            got[k] = max(got.get(k, 0), share)
        assert got == want
        hits += len(want)
    assert hits > 300


def test_license_labels_of_wrapped_and_other_texts():
    idx = licenses.index({})
    labels = lambda t: {idx.templates[k].label for k, *_ in idx.search(licenses.words(t))}
    assert labels("Released under the BSD License") == {"bsd-notice"} and labels("Licensed under the CC BY-NC 4.0.") == {"cc-by-nc-4.0"} and labels("Licensed under CC BY 4.0") == {"cc-by-4.0"}
    assert "apache-2.0" not in labels("Licensed under the MIT License, Version 2.0") and not labels("he had a driving license, released under the law")
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without"
                  " restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software") == {"mit-text"}
    assert "gpl-notice" in labels("This program is free software: you can redistribute it\nand/or modify it under the terms\nof the GNU General Public License")


def test_license_base(spark):
    docs = spark.createDataFrame([(1, "MIT License\nmit license"), (2, "GNU General Public License"), (3, "license mit")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (4, 2, 0, 2, "mit")
    assert (got[2].base_labels, got[2].first_word, got[3].n_base, got[3].first_word) == ("gpl", 1, 0, None)


def test_pii_spans_and_disclosure(spark):
    rows = [(1, "é mail a.b@c.de, +49 (0)30 1234567; 10.0.0.1; 4111 1111 1111 1111"), (2, "300.1.1.1 4111-1111--1111 1234 +12 a@b"), (3, "1.2.3.4.5;5500000000000004 x@y.z_q@e.fr")]
    rows += [(10 + i, f"note {i} owner zebrafish writes to bob@host.org about thing{i}") for i in range(4)] + [(50 + i, f"plain text about thing{i} and owner") for i in range(40)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert (got[2].n_email, got[2].n_ip, got[2].n_card, got[2].n_phone) == (0, 0, 0, 0)
    assert got[3].spans == "ip:0:7,card:10:26,email:27:32,email:32:39"
    assert got[1].spans.startswith("email:7:15,phone:17:")
    start = rows[3][1].index("zebrafish")
    assert f":{start}:{start + 9}" in got[10].spans and "owner" not in [rows[3][1][int(a) : int(b)] for _, a, b in (s.split(":") for s in got[10].spans.split(","))]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "zebrafish" not in clean[10] and "bob@" not in clean[10] and clean[50] == rows[7][1]


def test_pii_terms_far_from_the_entity(spark):
    far = lambda i: " ".join(f"filler{chr(97 + i)}{chr(97 + k)} word" for k in range(26))
    rows = [(i, f"Quagmire {far(i)} mail bob@host.org about thing{chr(97 + i)}") for i in range(4)] + [(50 + i, f"plain text {far(i % 20)}") for i in range(60)]
    assert all(t.index("bob@") > 2 * pii.WINDOW for _, t in rows[:4])
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("removed:0:8" in got[i] for i in range(4)) and not any(got[50 + i] for i in range(60))


def test_url_rules_and_tree(spark):
    pages = [(1, "http://A.example.NET/en/5?x"), (2, "http://x.net/a"), (3, None), (4, "nohost"), (5, "http://example.com/de/1"), (6, "http://z.org/fr/#t"), (7, "http://net"), (8, "http://notexample.com/de/9")]
    pages += [(100 + i, f"http://mixed.info/{'bad' if i % 2 else 'good'}/{i}") for i in range(400)]
    labels = [(i, int(i % 2 == 0), 0) for i in range(0, 400)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [(got[i].rule, got[i].verdict) for i in (1, 2, 5, 6)] == [("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    assert (got[1].host, got[1].path, got[3].host, got[3].path, got[7].rule, got[8].rule) == ("a.example.net", "/en/5", "", "", None, None)
    assert {got[100 + i].verdict for i in range(1, 400, 2)} == {"block"} and {got[100 + i].verdict for i in range(0, 400, 2)} == {"allow"}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.verdict for r in urls.judge(spark.createDataFrame(pages[7:], "page_id long, url string"), none).collect()} == {"allow"}


def test_classifiers_on_held_out_rows(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    for op, name in ((toxicity, "toxic"), (quality, "quality")):
        s = op.score(docs, op.fit(docs, labels)).where("held_out").join(labels, "doc_id")
        right, least = s.agg(F.avg((F.col("predicted") == F.col(name)).cast("double")), F.min("score")).first()
        assert right > 0.9 and least >= 0


def test_isotonic_is_monotone():
    r = np.random.default_rng(0)
    x = r.normal(size=500)
    k, p = isotonic.fit(x, (r.random(500) < 1 / (1 + np.exp(-x))).astype(float))
    assert (np.diff(p) >= 0).all() and (np.diff(isotonic.apply((k, p), np.linspace(-4, 4, 100))) >= 0).all()


def test_shingles_match_words():
    for t in ("a b c d e f", "A\tB\x0bc\rd  e f ", "ä Ö x", "", " \n", LONG):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        assert [x.decode() for x in shingles.words(t)] == w
        assert len(shingles.shingles(t)) == len(jaccard_sets({0: t})[0])


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(q) <= 255 for q in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    )
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0]))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


def test_pii_base_matches_brute_force_and_takes_any_text(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(1)
    parts = ["a@b.c", "@", ".", "1", "22.3", "+4", "4111 1111 1111 1111", "4111-1111", " ", "-", "  ", "x", "é", "255", "300", "_", "(", ")", "\n", "1.2.3.4", "+49 30 1234567"]
    texts = ["".join(r.choice(parts, int(r.integers(1, 60)))) for _ in range(600)]
    texts += ["a@b" + ".c" * 300_000, "x" * 600_000 + "@", "1" * 600_000 + "@+", "漢" * 600_000 + "@1+", "1 " + "- " * 300_000, "a@b.c " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.j for x in pii.base(docs).select("doc_id", pii._joined(F.col("spans")).alias("j")).collect()}
    assert all(got[i] == brute_pii(t) for i, t in enumerate(texts[:600])) and [bool(got[i]) for i in range(600, 605)] == [True, False, False, False, False]
    assert got[605].count("email") == 5000


def test_statistics_are_linear_in_unspaced_text():
    from netloom.llm import textstats

    for t in ("漢" * 500_000 + "1", "x" * 500_000 + "1", "a1" * 250_000, "a@" * 250_000):
        assert len(textstats.toxicity(t, {})) == len(textstats.TOXIC_STATS) and len(textstats.quality(t)) == len(textstats.QUALITY_STATS)


def test_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (5, a + " "), (5, b), (None, b), (None, "alone"), (9, b), (9, b), (7, None), (8, "")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.text) for r in exact_dedup.keep(docs).collect() if r.doc_id != 7) == sorted([(1, a), (5, a + " "), (5, b), (0, "alone")])
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.decide(docs).collect()}
    assert got == {(1, 1, True), (5, 1, False), (9, 1, False), (None, None, True), (7, 7, True), (8, 8, True)}
    labels = spark.createDataFrame([(5, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    from netloom.llm.common import training_rows

    assert sorted((r.doc_id, r.text) for r in training_rows(docs, labels, "quality", 4, 9, 10).collect()) == [(5, a + " "), (9, b)]


def test_url_tree_has_no_greatest_depth_and_takes_odd_tables(spark):
    deep = "/".join(f"s{'x' * i}" for i in range(20))
    pages = [(i, f"http://h.info/{deep}/{'bad' if i % 2 else 'good'}/more/{i}") for i in range(200)] + [(900, "http://z/~/{n}/*"), (900, "http://z/~/{n}/*"), (None, None), (901, "http://z/" + "y" * 100_000)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in pages], "page_id long, url string, verdict string, n int")
    got = urls.judge(df, labels).collect()
    assert len(got) == len(pages) and {g.verdict for g in got if g.page_id in range(1, 200, 2)} == {"block"} and {g.verdict for g in got if g.page_id in range(0, 200, 2)} == {"allow"}
    assert [g.template for g in got if g.page_id == 900] == ["/\\~/\\{n}/\\*"] * 2 or all("{n}" not in g.template.split("/") for g in got if g.page_id == 900)
    assert urls.judge(df.where("false"), labels).collect() == []
    merged = spark.createDataFrame([(i, f"http://m/{'ab'[i % 2]}/x/{'cd'[i // 2 % 2]}/{i}") for i in range(40)], "page_id long, url string")  # siblings that do not differ are one node
    assert {g.template for g in urls.judge(merged, labels.where("false")).collect()} == {"/~/x/~/{n}"}


def test_url_purity_matches_one_page_at_a_time(spark):
    """One host, two branches that differ: purities by the formula, level by level."""
    pages = [(i, f"http://h/{'b' if i % 4 == 0 else 'g'}/{i}") for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    got = {g.page_id: g for g in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()}
    step = lambda good, n, above: (good + urls.STRENGTH * above) / (n + urls.STRENGTH)
    top = step(60, 80, 61 / 81)
    for i, good, n in ((0, 0, 20), (1, 60, 60)):
        assert np.isclose(got[i].purity, step(good, n, step(good, n, top)))


def test_substring_dedup_against_brute_force(spark):
    """Every run of 50 words that stands in two documents is covered, but for one occurrence."""
    r = np.random.default_rng(11)
    own = lambda n: [f"u{x}" for x in r.integers(0, 10**9, n)]
    passages = [own(int(n)) for n in r.integers(52, 120, 6)]
    texts = []
    for k in range(30):
        w = own(int(r.integers(5, 200)))
        for q in r.choice(6, int(r.integers(0, 3)), replace=False):
            w += passages[q] + own(int(r.integers(0, 60)))
        breaks = set(r.choice(len(w), len(w) // 9, replace=False).tolist()) if k % 2 else set()
        texts.append("".join(x + ("\n" if i in breaks else " ") for i, x in enumerate(w)).strip())
    words_of = [t.split() for t in texts]
    runs: dict[tuple, set[int]] = {}
    for d, w in enumerate(words_of):
        for i in range(len(w) - 49):
            runs.setdefault(tuple(w[i : i + 50]), set()).add(d)
    shared = [(x, ds) for x, ds in runs.items() if len(ds) > 1]
    got = substring_dedup.removals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    gone = {d: set() for d in range(30)}
    for g in got:
        gone[g.doc_id] |= set(texts[g.doc_id][g.start : g.end].split())
    assert len(shared) > 50
    for x, ds in shared:
        assert sum(bool(gone[d] & set(x)) for d in ds) >= len(ds) - 1
    twice = {d for _, ds in shared for d in ds}
    assert {g.doc_id for g in got} <= twice and {g.keep_doc_id for g in got} <= twice


def test_ridge_matches_direct_solution(spark):
    """Partition-summed normal equations equal one least-squares solution over the same rows; scores equal the formula."""
    from netloom.llm import textstats
    from netloom.llm.common import training_rows

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = [r for r in training_rows(docs, labels, "quality", quality.FOLDS, quality.HELD, quality.FIT_ROWS).collect()]
    x, y = np.array([textstats.quality(r.text) for r in rows if r.part]), np.array([r.y for r in rows if r.part], float)
    assert np.allclose(model.mean, x.mean(0))
    z = model.lift(x)
    beta = np.linalg.lstsq(np.concatenate([z, np.sqrt(quality.RIDGE) * np.eye(z.shape[1])]), np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(beta, model.beta, atol=1e-6)
    knots = isotonic.fit(model.lift(np.array([textstats.quality(r.text) for r in rows if not r.part])) @ beta, np.array([r.y for r in rows if not r.part], float))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in docs.limit(40).collect():
        want = isotonic.apply(knots, model.lift(np.array([textstats.quality(r.text or "")])) @ beta)[0]
        assert abs(got[r.doc_id] - want) < 1e-5


def test_boosting_reaches_the_best_single_cut():
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(400, 3)), 1)
    y = (x[:, 1] > 0.3).astype(float)
    trees = toxicity.boost(x, y, rounds=1, depth=1, rate=1.0)
    gain = lambda j, c: sum((g := (y - trees_base)[m]).sum() ** 2 / (len(g) * trees_base * (1 - trees_base) + 2.0) for m in (x[:, j] <= c, x[:, j] > c))
    trees_base = (y.sum() + 1) / (len(y) + 2)
    best = max((gain(j, c), j) for j in range(3) for c in np.unique(x[:, j])[:-1])
    assert trees.feature[0][0] == best[1] == 1 and ((trees.raw(x) > 0) == (y > 0.5)).mean() > 0.95


def test_pipeline_rows_are_what_brute_force_keeps(spark):
    """Each stage on its own input: what goes had to go, what stays had to stay."""
    import corpus_pipeline
    from netloom.llm.common import cut

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    items = {r.item_id: decontaminate.words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        columns = docs.columns
        docs = cut(stage(spark, docs, sf), name)
        kept = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and kept <= set(before) and len(kept) > 100
        if name == "exact_dedup":
            least: dict[str, int] = {}
            for d in sorted(before):
                least.setdefault(norm(before[d]), d)
            assert kept == set(least.values())
        if name == "near_dedup":
            sets, root = jaccard_sets(before), {d: d for d in before}
            find = lambda d: d if root[d] == d else find(root[d])  # noqa: B023, E731
            for a, b in itertools.combinations(sorted(before), 2):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
            assert kept == {d for d in before if find(d) == d}
        if name == "decontaminate":
            for d, t in before.items():
                w = decontaminate.words(t or "")
                held = [i for i, x in items.items() if x and any(w[k : k + len(x)] == x for k in range(len(w) - len(x) + 1))]
                assert not (held and d in kept)
                if d not in kept:  # at least half of some item's 5-word runs stand there
                    assert any(len(decontaminate.grams(x) & decontaminate.grams(w)) >= 0.5 * len(decontaminate.grams(x)) for x in items.values() if x)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == kept


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline
    from netloom.llm.common import cut

    spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "q w e r t y u i o p a s d f g")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            if name == "quality" and not docs.isEmpty():
                continue  # it may reject all of these
            docs = cut(stage(spark, docs, str(tmp_path)), name)
        got = [r.doc_id for r in docs.collect()]
        assert sorted(x or 0 for x in got) == ([] if not got else [1, 3, 4, 6, 7])
