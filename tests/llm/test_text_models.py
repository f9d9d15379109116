"""Operators 2, 3, 4 and 7: held-out accuracy, brute force and planted cases."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import decontamination, langid, licenses, toxicity
from pagewright.llm._common import crc_mod


def test_viterbi_is_exact():
    r = np.random.default_rng(0)
    lengths = [5, 0, 3, 1, 6]
    scores = r.normal(size=(sum(lengths), 3)) * 3
    at = np.concatenate([[0], np.cumsum(lengths)])
    got = langid.viterbi(scores, at, 2.0)
    for a, b in itertools.pairwise(at):
        value = lambda path, a=a: sum(scores[a + t, s] for t, s in enumerate(path)) - 2.0 * sum(x != y for x, y in itertools.pairwise(path))
        best = max((value(p) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert value(got[a:b].tolist()) == pytest.approx(best)


def test_viterbi_of_many_labels():
    """200 labels: numbers beyond 127."""
    r = np.random.default_rng(1)
    lengths, penalty = [40, 0, 7], 2.5
    scores = r.normal(size=(sum(lengths), 200)) * 2
    at = np.concatenate([[0], np.cumsum(lengths)])
    got = langid.viterbi(scores, at, penalty)
    assert got.min() >= 0 and got.max() > 127
    for a, b in itertools.pairwise(at):
        best = np.zeros(200)
        for t in range(a, b):  # the textbook recursion
            best = scores[t] + (np.maximum(best, best.max() - penalty) if t > a else 0)
        path = got[a:b]
        value = scores[np.arange(a, b), path].sum() - penalty * (np.diff(path) != 0).sum()
        assert value == pytest.approx(best.max() if b > a else 0)


def test_many_languages(spark):
    """200 languages, each of words of its own."""
    names = [f"l{k:03d}" for k in range(200)]
    r = np.random.default_rng(2)
    words = {n: ["".join(chr(0x61 + int(c)) for c in r.integers(0, 26, 6)) for _ in range(12)] for n in names}
    rows = [(k * 4 + j, " ".join(words[n][(j + i * 5) % 12] for i in range(12)), n) for k, n in enumerate(names) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == names
    got = {x["doc_id"]: x["lang_pred"] for x in langid.identify(docs, model).collect()}
    assert sum(got[i] == n for i, _, n in rows) >= 0.98 * len(rows)


def test_language(spark, docs, no_docs, small):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.train(whole.where(~held))
    assert model.languages == sorted({r["lang"] for r in whole.select("lang").distinct().collect()})
    got = langid.identify(whole, model).join(whole.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    by = {r["lang"]: r["text"].replace("\n", " ") for r in whole.where("n_chars > 900").select("lang", "text").collect()}
    mixed = by["en"][:600] + " " + by["de"][:600]
    rows = spark.createDataFrame([(1, mixed), (2, None), (3, "123 !!"), (4, ""), (5, "привет мир")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in langid.identify(rows, model).collect()}
    assert [s["lang"] for s in out[1]["spans"]] == ["en", "de"] and abs(out[1]["spans"][1]["start"] - 600) < 40
    assert [(out[k]["lang_pred"], out[k]["score"]) for k in (2, 3, 4)] == [("und", 0.0)] * 3
    assert out[5]["lang_pred"] in model.languages
    found = langid.identify(docs, model).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert langid.identify(docs, model).count() == docs.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in found if r["doc_id"] in (4, 5, 6))
    assert all(r["lang_pred"] != "und" and 0 < r["score"] <= 1 for r in found if r["doc_id"] in (1, 2, 3, 7, 10))
    assert len({(r["lang_pred"], r["score"]) for r in found if r["doc_id"] in (1, 2)}) == 1 and len({str(r["spans"]) for r in found if r["doc_id"] == 8}) == 1
    assert langid.identify(no_docs, model).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(no_docs)).collect()} == {"und"}


def test_fold():
    assert toxicity.fold(["ST0P th1s, Idіоt $tuff 2024!", ""])[0].split()[:4] == ["stop", "this", "idiot", "stuff"]
    assert toxicity.fold(["a", "", "bc"]) == [" a ", "  ", " bc "]


def test_matcher():
    model = toxicity.ToxModel({" trash": 2.0, " idiot ": 3.0}, ["trash can"])
    m = toxicity.Matcher(model)
    hits = lambda t: [w for _, w in m.hits(toxicity.fold([t])[0])]
    assert hits("an 1diot and trashy") == [3.0, 2.0]
    assert hits("the trash can is full") == []
    assert hits("idiotic") == []
    assert toxicity.Matcher(toxicity.ToxModel()).hits(" x ") == []


def test_matcher_by_brute_force():
    """Every entry and exception looked for at every place."""
    import random

    r = random.Random(9)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randrange(1, 5)))
    for _ in range(200):
        entries = {f" {word()}" + r.choice(["", " "]): float(k + 1) for k in range(6)}
        free = [f"{word()} {word()}" for _ in range(3)]
        (text,) = toxicity.fold([" ".join(word() for _ in range(40))])
        covered = {i for x in free for m in range(len(text)) if text.startswith(f" {x} ", m) for i in range(m, m + len(x) + 1)}
        want = []
        for m in range(len(text)):
            weights = [w for e, w in entries.items() if text.startswith(e, m)]
            if weights and m not in covered:
                want.append((m, max(weights)))
        assert toxicity.Matcher(toxicity.ToxModel(entries, free)).hits(text) == want


def test_licenses_by_brute_force():
    """Lines far from each other: each is classified by its own row of grams and compared with all templates of its family."""
    import random

    import pyarrow as pa

    r = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    p = licenses.LicenseParams(variants=12, epochs=60)
    model = licenses.fit([" ".join(r.choice(words) for _ in range(20)) for _ in range(200)], p)
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(r.randrange(1, 5)):
            own = r.choice(licenses.TEMPLATES[r.choice(licenses.FAMILIES[:-1])]).split() if r.random() < 0.6 else [r.choice(words) for _ in range(r.randrange(1, 60))]
            keep = own[: r.randrange(1, len(own) + 1)] if r.random() < 0.5 else own
            lines.append(" ".join([*(r.choice(words) for _ in range(r.randrange(3))), *keep]))
        texts.append("\n\n".join(lines))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = [x for b in licenses._scan(iter([batch]), model, p) for x in b.to_pylist()]
    n = 0
    for t, row in zip(texts, got, strict=True):
        want = []
        for k, line in enumerate(t.split("\n")):
            if licenses._clean(line).split():
                probability = model.probabilities(licenses._matrix([line], p) @ model.weights[:-1] + model.weights[-1])[0]
                top = int(probability[:-1].argmax())
                sim = licenses.best_similarity(line, licenses.FAMILIES[top])
                if probability[top] >= model.bar and sim >= p.similarity:
                    want.append((licenses.FAMILIES[top], k, round(float(probability[top]), 4), sim))
        assert sorted((e["family"], e["line"], round(e["probability"], 4), e["similarity"]) for e in row["found"]) == sorted(want)
        n += len(want)
    assert n > 30


def test_toxicity(spark, docs, no_docs):
    d = "/root/testdata/sf0.1"
    whole, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.train(whole, labels.where(~held))
    assert " idiot " in model.entries
    got = toxicity.score_toxicity(whole, model).join(labels.where(held), "doc_id").collect()
    wrong = sum((r["score"] >= 0.5) != bool(r["toxic"]) for r in got)
    assert wrong <= 0.03 * len(got)
    planted = spark.createDataFrame([(1, "the thing is an 1d1ot and a m0ron of the worth1ess kind"), (2, "the thing and the other thing"), (3, None), (4, "")], "doc_id long, text string")
    out = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(planted, model).collect()}
    assert out[1] >= 0.5 > max(out[k] for k in (2, 3, 4))
    assert out[3] == out[4]
    dotted = spark.createDataFrame([(1, "the 1d1ot and the thing of it is here"), (2, "the... 1d1ot!!! (and) -- the // thing, of; it: is -- here ...")], "doc_id long, text string")
    same = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(dotted, model).collect()}
    assert same[1] == pytest.approx(same[2]) and same[1] > out[4]  # marks are no words
    scored = [(r["doc_id"], r["score"], r["hits"]) for r in toxicity.score_toxicity(docs, model).collect()]
    assert len(scored) == docs.count()
    assert {s for i, s, _ in scored if i in (4, 5, 6)} == {out[3]} and all(h == 0 and s < 0.5 for i, s, h in scored if i in (1, 2, 7, 14, 16))
    assert len({x for x in scored if x[0] == 8}) == 1
    assert toxicity.score_toxicity(no_docs, model).collect() == []
    none = toxicity.train(whole, labels.where("toxic = 0"))
    assert not none.entries


def test_licenses(spark, docs, no_docs, small):
    whole = spark.read.parquet(f"{small}/documents.parquet")
    model, again = licenses.train(whole, licenses.LicenseParams(background=60)), licenses.train(whole.repartition(5), licenses.LicenseParams(background=60))
    assert (model.weights == again.weights).all() and (model.temperature, model.bar) == (again.temperature, again.bar)
    model = licenses.train(whole)
    background = "the thing and of onon ther with is was tion in the and"
    rows = [
        (1, f"{background}\nLicensed under the Apache License, Version 2.0.\n{background}", "apache-2.0"),
        (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction", "mit"),
        (3, background, None),
        (4, None, None),
        (5, "", None),
        (6, "She got her driving license last year.", None),
        (7, "This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
        (8, background * 30 + "\nAll rights reserved.", "all-rights-reserved"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model).collect()}
    assert {k: r["license"] for k, r in got.items()} == {k: e for k, _, e in rows}
    assert got[1]["found"][0]["line"] == 1 and got[4]["n_paragraphs"] == 0
    scanned = licenses.scan_licenses(docs, model).collect()
    assert len(scanned) == docs.count() and all(r["license"] is None and r["found"] == [] for r in scanned)
    assert {r["n_paragraphs"] for r in scanned if r["doc_id"] in (4, 5, 6)} == {0} and {r["n_paragraphs"] for r in scanned if r["doc_id"] == 7} == {-(-30_000 // 64)}
    assert licenses.scan_licenses(no_docs, licenses.train(no_docs)).collect() == []


ITEM = "In the year 1999 a farmer called Tom Baker sold 12 kg of apples to Mary for 30 dollars, and later on that same day Tom Baker also went out and bought another 7 pears there."


def test_decontamination(spark, docs, no_docs, small):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "five words make this item")], "item_id long, text string")
    swap = ITEM.replace("1999", "2003").replace("Tom Baker", "Ann").replace("12", "55").replace("Mary", "Joe").replace("30", "81").replace("7 pears", "4 pears")
    torn = swap.replace("day Ann", "day Zoe")
    rows = [(1, f"lead words here. {ITEM} tail words"), (2, f"lead words here. {swap} tail"), (3, "nothing of the kind is in this text at all"), (4, None), (5, ""), (6, "so five words make this item indeed"), (7, ITEM.upper()), (8, torn)]
    got = {r["doc_id"]: r for r in decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert {k: r["item_id"] for k, r in got.items() if k != 8} == {1: 1, 2: 1, 3: None, 4: None, 5: None, 6: 4, 7: 1}
    assert got[1]["coverage"] == 1.0 and got[1]["consistency"] == 1.0
    assert not got[8]["contaminated"] or got[8]["consistency"] < 1.0
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert decontamination.decontaminate(no_docs, items).collect() == []
    assert decontamination.decontaminate(docs, items.where("false")).where("contaminated").count() == 0


def brute_occurrence(matched, windows, words, p):
    """matched: (item place, document place, item slots, document slots). Has any occurrence the coverage and the consistency?"""
    total = sum(weight for weight in windows.values())
    groups = {}
    for m in matched:
        shift = m[1] - m[0]
        names = [(0, 0), (1, shift)]
        for scale, part in ((2, 8), (3, 2)):
            band = shift // max(1, words // part)
            names += [(scale, band), (scale, band - 1)]
        for name in names:
            groups.setdefault(name, []).append(m)
    for own in groups.values():
        if sum(windows[i] for i in {m[0] for m in own}) < p.coverage * total:
            continue
        slots = {}
        for _, _, a, b in own:
            for x, y in zip(a, b, strict=True):
                if x:
                    slots.setdefault(x, []).append(y)
        every = sum(map(len, slots.values()))
        if not every or sum(max(v.count(y) for y in set(v)) for v in slots.values()) >= p.consistency * every:
            return True
    return False


def brute_contaminated(texts, items, p=decontamination.DeconParams()):
    """Window by window in Python, by the canonical words that are tested elsewhere."""
    from collections import defaultdict

    out = set()
    rows = [(decontamination._typed([t]), t) for t in texts]
    for item in items:
        kinds = []
        for names in (True, False):
            token, slot, _, value, _ = decontamination._typed([item], names=names)
            w = min(p.width, len(token))
            if w:
                windows = {k: int((slot[k : k + w] == 0).sum()) for k in range(len(token) - w + 1)}
                keep = {k: n for k, n in windows.items() if n >= min(w, max(2, -(-p.literals * w // 1)))}
                kinds.append((0, token, slot, w, keep))
                if names and len(keep) < len(windows):
                    w2 = min(p.width, len(value))
                    kinds.append((2, value, np.zeros_like(value), w2, dict.fromkeys(range(len(value) - w2 + 1), w2)))
        for d, (typed, _) in enumerate(rows):
            for kind, token, slot, w, keep in kinds:
                words, slots = (typed[3], np.zeros_like(typed[3])) if kind == 2 else (typed[0], typed[1])
                where = defaultdict(list)
                for k in range(len(words) - w + 1):
                    where[words[k : k + w].tobytes()].append(k)
                matched = [(i, k, slot[i : i + w].tolist(), slots[k : k + w].tolist()) for i in keep for k in where.get(token[i : i + w].tobytes(), ())]
                if kind != 2:  # document windows are held to the same share of plain words: equal tokens, so equal shares
                    matched = [m for m in matched if sum(x == 0 for x in m[3]) >= min(w, max(2, -(-p.literals * w // 1)))]
                if matched and brute_occurrence(matched, keep, len(token), p):
                    out.add(d)
    return out


def test_slots_by_brute_force(spark, small):
    """Whole tables at sf0.001, with copies of items given other values, consistently and not."""
    import random
    import re

    r = random.Random(6)
    items = [x["text"] for x in spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").collect()] + [ITEM, SUMS, BOX]
    texts = [x["text"] or "" for x in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    for item in (ITEM, SUMS, BOX):
        for _ in range(6):
            new = {v: str(r.randrange(2, 999)) for v in re.findall(r"\d+", item)}
            texts.append("Some lead. " + re.sub(r"\d+", lambda m, new=new: new[m[0]], item) + " And a tail.")
            texts.append("Some lead. " + re.sub(r"\d+", lambda m: str(r.randrange(2, 999)), item))
            cut = item.split()
            texts.append(" ".join(cut[: r.randrange(len(cut))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute_contaminated(texts, items)
    for p in (decontamination.DeconParams(), decontamination.DeconParams(broadcast_rows=0)):
        assert {x["doc_id"] for x in decontamination.decontaminate(docs, table, p).where("contaminated").collect()} == want
    assert 0 < len(want) < len(texts)


SUMS = "Compute 12 plus 34 minus 56 times 78 over 9 and 10 less 11 by 13"
BOX = "A box holds 12 red pens and since 12 red pens weigh 30 grams it is plain that 30 grams of pens are 12 of them."


def test_number_rich_items(spark):
    items = spark.createDataFrame([(1, SUMS), (2, BOX)], "item_id long, text string")
    other = "Compute 5 plus 61 minus 7 times 80 over 3 and 14 less 2 by 99"
    rows = [(1, f"Lead. {SUMS} and a tail", 1), (2, f"Lead. {other} and a tail", 1), (3, BOX.replace("12", "7").replace("30", "400"), 2), (4, BOX.replace("12 red", "5 red").replace("since 5", "since 8").replace("30 grams it", "2 grams it"), None)]
    rows += [(5, "Compute 3 plus 4 and then stop here, since 5 plus 6 is another sum and no item at all", None), (6, "12 34 56 78 9 10 11 13", None)]
    got = {r["doc_id"]: r["item_id"] for r in decontamination.decontaminate(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), items).collect()}
    assert got == {k: i for k, _, i in rows}


def test_leaks_by_brute_force(spark, small):
    whole, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    norm = lambda t: " ".join(t.lower().split())
    known = [norm(r["text"]) for r in items.collect()]
    leaked = {r["doc_id"] for r in whole.collect() if any(k in norm(r["text"]) for k in known)}
    got = {r["doc_id"] for r in decontamination.decontaminate(whole, items).where("contaminated").collect()}
    assert leaked and leaked <= got
    canon = lambda t: decontamination.canonical([t])[0].tolist()
    windows = [{tuple(c[k : k + 8]) for k in range(len(c) - 7)} for c in map(canon, (r["text"] for r in items.collect()))]
    for r in whole.where(F.col("doc_id").isin(list(got - leaked))).collect():
        c = canon(r["text"])
        own = {tuple(c[k : k + 8]) for k in range(len(c) - 7)}
        assert any(w and len(w & own) >= 0.5 * len(w) for w in windows)


def test_occurrences(spark):
    """Copies of one item with other values, side by side and far apart, and an item's copy among windows of the same shape."""
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    swap = ITEM.replace("1999", "2003").replace("Tom Baker", "Ann").replace("12", "55").replace("Mary", "Joe").replace("30", "81").replace("7 pears", "4 pears")
    third = swap.replace("2003", "1870").replace("Ann", "Eve").replace("55", "6").replace("81", "9")
    longer = swap.replace("for 81 dollars", "for no more than 81 dollars")
    stray = " ".join(f"and so {a} called Tim{k} Low sold {k} kg of apples to Kim{k} for {k * 3} dollars." for k, a in enumerate(["a farmer"] * 60))
    rows = [(1, f"{ITEM} {swap}"), (2, f"{swap} {third}"), (3, f"{swap} " + "some other words " * 200 + third), (4, f"{longer} {third}"), (5, f"{ITEM} {stray}"), (6, stray), (7, "nothing of it")]
    got = {r["doc_id"]: r["contaminated"] for r in decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {k: k < 6 for k in range(1, 8)}


def test_items_of_few_plain_words(spark):
    sums, names = "12 + 7 = 19, 8 + 5 = 13, 20 - 4 = 16, 9 + 9 = 18", "Then Ann, Bob, Cid and Dan owe Eve 3, Fay 4, Gil 5 and Hal 6 dollars to Ida or Jon Low."
    items = spark.createDataFrame([(1, sums), (2, names)], "item_id long, text string")
    other = sums.replace("19", "29").replace("13", "43").replace("16", "36").replace("18", "48")
    rows = [(1, f"Some lead: {sums} and a tail", 1), (2, f"some words. {names} More words.", 2), (3, f"Lead: {other} and a tail", None), (4, "12 7", None), (5, names.lower(), 2), (6, None, None), (7, f"{other} {sums}", 1)]
    got = {r["doc_id"]: r["item_id"] for r in decontamination.decontaminate(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), items).collect()}
    assert got == {k: i for k, _, i in rows}


def test_wrapped_licenses(spark, small):
    import textwrap

    model = licenses.train(spark.read.parquet(f"{small}/documents.parquet"))
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    apache = licenses.TEMPLATES["apache-2.0"][1]
    word = "the thing and of onon ther with is was tion in the and"
    rows = [(1, f"MIT License\n\nCopyright (c) 2020 A Person\n\n{mit}\n\nThe above notice", "mit"), (2, "\n".join(f"# {x}" for x in textwrap.wrap(gpl, 40)), "gpl-3.0"), (3, "\n".join(textwrap.wrap(apache, 30)), "apache-2.0")]
    rows += [(10 + k, f"{'and the of ' * 30}"[: 3 * k] + "\n" + " ".join(["thing"] * (40 + k)) + " " + apache + " " + word, "apache-2.0") for k in range(0, 24, 4)]
    notices = [(family, t) for family, own in licenses.TEMPLATES.items() for t in own if len(t.split()) > 14]
    rows += [(100 + 10 * k + w, f"{word}\n\n" + "\n".join(textwrap.wrap(t, 60 + 12 * w)) + f"\n\n{word}", family) for k, (family, t) in enumerate(notices) for w in range(2)]
    rows += [(40, "\n".join([word] * 30), None), (41, "She got her driving\nlicense last year", None)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model).collect()}
    assert {k: r["license"] for k, r in got.items()} == {k: e for k, _, e in rows}
    assert got[1]["found"][0]["line"] == 4 and len(got[1]["found"]) == 1


def test_exceptions_of_all_hits():
    import pyarrow as pa

    model = toxicity.ToxModel({" trash": 2.0}, ["trash can", "of trash"])
    text = " ".join(f"w{k} trash x{k}" for k in range(200)) + " a trash can and sort of trash trash"
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([text])], ["id", "text"])
    (row,) = next(toxicity._measure(iter([batch]), model)).to_pylist()
    folded = toxicity.fold([text])[0]
    free = [(m, m + len(x) + 1) for x in model.exceptions for m in range(len(folded)) if folded.startswith(f" {x} ", m)]
    hits = [m for m in range(len(folded)) if folded.startswith(" trash", m) and not any(a <= m < b for a, b in free)]
    assert row["hits"] == len(hits) == 201
    words = folded.split()
    assert set(row["phrases"]) == {f"{a} {b}" for a, b, m in zip(words, words[1:], range(len(words))) if ("trash" in (a, b)) and m < 600} | {"trash trash"}


def test_many_notices_in_a_text():
    """Time grows with the text, not with its square; each line is found once."""
    import time

    import pyarrow as pa

    model = licenses.fit([f"other words of the corpus {k} and {k * 7}" for k in range(300)])
    took = {}
    for n in (2_000, 100_000):
        batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["All rights reserved.\n" * n])], ["doc_id", "text"])
        began = time.perf_counter()
        (row,) = next(licenses._scan(iter([batch]), model, licenses.LicenseParams())).to_pylist()
        took[n] = time.perf_counter() - began
        assert row["license"] == "all-rights-reserved" and row["n_paragraphs"] == n
        assert len({e["line"] for e in row["found"]}) == len(row["found"]) == n
    assert took[100_000] < 150 * max(took[2_000], 0.05)


def test_a_piece_is_compared_not_its_line():
    """A notice elsewhere in a long line doesn't confirm a piece that a family was guessed for."""
    import pyarrow as pa

    model = licenses.fit([f"other words of the corpus {k} and {k * 7}" for k in range(300)])
    mit = licenses.TEMPLATES["mit"][1]
    line = mit + " " + " ".join(f"word{k}" for k in range(200)) + " mit license granted copy"
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([line])], ["doc_id", "text"])
    (row,) = next(licenses._scan(iter([batch]), model, licenses.LicenseParams())).to_pylist()
    assert row["license"] == "mit" and len(row["found"]) == 1


def test_learned_exceptions_free_texts(spark, tmp_path):
    """In the query's own path: a toxic word that clean texts have in one phrase only. With the phrase learned, held-out clean texts are clean."""
    import random

    r = random.Random(1)
    fill = lambda: " ".join(f"w{r.randrange(3000)}" for _ in range(40))
    rows, labels = [], []
    for k in range(1500):
        kind = k % 5
        bad = "you scum go away " if kind == 0 else "the scum bucket " if kind == 1 else ""
        rows.append((k, f"{fill()} {bad}{fill()}", "en", "s", 1))
        labels.append((k, 1, int(kind == 0)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = [x for x in toxicity.op3_toxicity(spark, str(tmp_path)).collect() if x["held_out"]]
    assert {x["predicted"] for x in got if x["doc_id"] % 5 == 0} == {1}
    freed = [x for x in got if x["doc_id"] % 5 == 1]
    assert len(freed) > 20 and all(x["hits"] == 0 and x["predicted"] == 0 for x in freed)
    model = toxicity.train(*(spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels")))
    assert any("scum" in x for x in model.exceptions)


def test_the_whole_word_before_a_hit():
    import pyarrow as pa

    long = "x" * 90
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([f"{long} trash y. trash"])], ["id", "text"])
    (row,) = next(toxicity._measure(iter([batch]), toxicity.ToxModel({" trash ": 2.0}))).to_pylist()
    assert set(row["phrases"]) == {f"{long} trash", "trash y", "y trash"}


def test_families_by_brute_force(spark, small):
    """Every line of every text of a table against every template: what compares well is found under its family, what compares with nothing isn't."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    word = "thing and of the "
    rows += [(10_000 + k, f"{word * 5}\n{t}\n{word * 3}") for k, t in enumerate(t for own in licenses.TEMPLATES.values() for t in own if len(t.split()) > 4)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licenses.train(docs)).collect()}
    clear = 0
    for doc_id, text in rows:
        lines = [x for x in (text or "").split("\n") if x.strip() and len(x.split()) <= 64]
        best = {f: max((licenses.best_similarity(x, f) for x in lines), default=0.0) for f in licenses.FAMILIES[:-1]}
        families = {e["family"] for e in got[doc_id]["found"]}
        whole = [f for f, s in best.items() if s == 1.0]
        if len(whole) == 1 and sorted(best.values())[-2] < 0.5:
            clear += 1
            assert got[doc_id]["license"] == whole[0], (doc_id, best)
        if len(lines) == len([x for x in (text or "").split("\n") if x.strip()]) and "\n" not in (text or "").strip():
            assert all(best[f] >= 0.5 for f in families), doc_id
        if not families:
            assert not [f for f, s in best.items() if s == 1.0 and all(len(t.split()) > 4 for t in licenses.TEMPLATES[f])], doc_id
    assert clear >= 10
