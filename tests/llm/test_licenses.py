"""Phrases against a plain search, templates by position, and the edge cases."""

import re

from demur.llm import licenses as lic

PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def plain(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    None,
    "",
    "The MIT-License, the mit\nlicense; MIT Licenses. É MIT License",
    "Released under the MIT License. Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "under the apache license version 3 0",
    "mit license " * 3000,
    "word " * 20000 + "general public license",
    "the license of mit",
]


def test_scan(spark):
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, w int, found string")
    rows = {r["doc_id"]: r for r in lic.scan_licenses(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(t), i
        assert 0 <= r["score"] <= 1
    assert rows[3]["labels"] == "apache,apache-2.0,mit"
    assert rows[4]["labels"] == "gpl,gpl-3.0"
    assert rows[5]["labels"] == "cc-by-nc-4.0" and rows[5]["score"] >= 0.5
    assert rows[6]["labels"] == "apache"  # the template's key phrase is not there
    assert rows[9]["labels"] == "" and rows[9]["score"] == 0


NO_LICEN = [
    ("Content under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("photos under CC BY 4.0, (c) 2020", "cc-by-4.0"),
    ("text under CC-BY-NC-4.0", "cc-by-nc-4.0"),
    ("Under a Creative Commons Attribution 4.0 International", "cc-by"),
    ("use copy modify and or distribute this software for any purpose\nwith or  without fee is", "isc"),
    (
        "unless required by\napplicable law or agreed to in writing software distributed under the terms is distributed"
        " on an as is basis without warranties or conditions of any kind",
        "apache-2.0",
    ),
    ("the cc of a mail, by fee", ""),
]


def test_templates_without_the_word_license(spark):
    texts = [t for t, _ in NO_LICEN] + [t.text for t in lic.TEMPLATES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lic.scan_licenses(docs).collect()}
    for i, (_, label) in enumerate(NO_LICEN):
        assert rows[i]["labels"] == label, i
        assert (rows[i]["score"] >= 0.5) == bool(label), i
    for i, t in enumerate(lic.TEMPLATES, len(NO_LICEN)):
        assert t.label in rows[i]["labels"].split(","), t.label


def test_labels_do_not_depend_on_other_texts(spark):
    scan = lambda rows: {
        r["doc_id"]: (r["labels"], r["score"], r["found"]) for r in lic.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    }
    own = [(i, t) for i, (t, _) in enumerate(NO_LICEN)] + [(20, "Photos under a Creative Commons Attribution."), (21, TEXTS[3]), (21, TEXTS[3])]
    others = [(100 + i, t.text) for i, t in enumerate(lic.TEMPLATES)] * 3 + [(300, "license attribution of the fee 4 0 by creative " * 9)] * 40
    alone, beside = scan(own), scan(own + others)
    assert alone[20][0] == "cc-by" and alone[21][0] == "apache,apache-2.0,mit"
    assert all(alone[i][0] == label for i, (_, label) in enumerate(NO_LICEN))
    for row in own:
        assert scan([row])[row[0]] == alone[row[0]] == beside[row[0]]


def test_every_template_by_plain_search(spark):
    # whole, cut at either end, with a key word changed, and twice in one text
    rows, want = [], []
    for t in lic.TEMPLATES:
        w = t.text.split()
        first = min(lic._key_places(t))
        last = max(p + len(k.split()) for k, p in zip(t.keys, lic._key_places(t)))
        changed = list(w)
        changed[first] = "zzz"
        for text in (t.text.upper(), " ".join(w[first:last]), "x y " + " ".join(w[:last]), ", ".join(changed), f"{t.text}. {t.text}"):
            words = re.findall("[a-z0-9]+", text.lower())
            found = set()
            for u in lic.TEMPLATES:
                keys = list(zip([k.split() for k in u.keys], lic._key_places(u)))
                if any(all(s + p >= 0 and words[s + p : s + p + len(k)] == k for k, p in keys) for s in range(-len(u.text.split()), len(words))):
                    found.add(u.label)
            rows.append((len(rows), text))
            want.append(found)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: {f["label"] for f in r["found"]} for r in lic.scan_licenses(docs).collect()}
    for i, found in enumerate(want):
        assert got[i] == found, rows[i]


def test_documents_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in lic.scan_licenses(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(texts[r["doc_id"]])
    assert lic.scan_licenses(docs.where("doc_id < 0")).count() == 0
