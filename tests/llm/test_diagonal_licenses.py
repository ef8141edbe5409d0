import re

import numpy as np

from dailybars.llm import diagonal_licenses as dl

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plainly(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in dl.PHRASES:
        p = phrase.split()
        here = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_scan(spark):
    rng = np.random.default_rng(2)
    filler = lambda n: " ".join(rng.choice(["x1", "ab", "été", "by", "cc", "ÉA"], n))
    apache, mit = dl.TEMPLATES[0][1], dl.TEMPLATES[2][1]
    texts = [filler(300) for _ in range(30)] + [
        f"{filler(40)} {apache} {filler(40)}", f"{filler(9)} {mit.replace('free of charge', 'free of any charge')} {filler(3)}", apache.upper() + " " + mit,
        "All rights reserved. CC-BY, cc by; the GENERAL public License", "all rights", "Licensed under the Apache License, Version 2.0.\n" * 40, " ".join(mit.split()[:5]), "", None, "...", filler(60_000)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[30], "x"), (31, texts[31], None)]
    got = dl.scan(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()
    assert len(got) == len(rows)
    assert sorted(((r["doc_id"], *(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))) for r in got), key=str) == sorted(((d, *plainly(t)) for d, t, _ in rows), key=str)
    more = {r["doc_id"]: r for r in got}
    assert more[30]["labels"].split(",")[0] == "apache-2.0" and "mit" in more[31]["labels"] and more[31]["score"] > 0.7
    assert {"apache-2.0", "mit"} <= set(more[32]["labels"].split(",")) and more[32]["score"] == 1
    assert more[33]["labels"] == "cc-by,gpl,reserved" and more[35]["labels"] == "apache-2.0"
    assert more[36]["labels"] == "" and more[36]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got)
    assert dl.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def labels(spark, texts):
    rows = dl.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(set(r["labels"].split(",")) - {""}, r["score"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_short_statements(spark):
    wanted = {
        "Released under the MIT License.": {"mit"}, "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc"}, "CC BY-SA 3.0": {"cc-by", "cc-by-sa"}, "(CC BY-ND)": {"cc-by", "cc-by-nd"},
        "CC BY-NC-SA 4.0": {"cc-by", "cc-by-nc-sa"}, "cc-by-nc-nd": {"cc-by", "cc-by-nc-nd"}, "CC BY 4.0": {"cc-by", "cc-by-4.0"},
        "https://creativecommons.org/licenses/by-nc/4.0/": {"cc-by-nc"}, "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": {"cc-by-nc-sa"},
        "Code is available under the ISC license": {"isc"}, "released under the Unlicense": {"unlicense"}, "Distributed under the BSD license": {"bsd"}, "BSD 3-Clause License": {"bsd-3-clause"},
        "Licensed under the LGPL.": {"lgpl"}, "GNU Lesser General Public License v3": {"gpl", "lgpl"}, "GNU Affero General Public License": {"agpl", "gpl"},
        "Mozilla Public License 2.0": {"mpl-2.0"}, "Mozilla Public License 1.1": {"mpl"}, "Licensed under the Apache License 2.0": {"apache-2.0"}, "SPDX-License-Identifier: MIT": {"mit"},
        "Permission is hereby granted, free of charge": {"mit"}, "licensed under MIT": {"mit"}, "the license of MIT": set(), "under the roof of the licence office": set()}
    assert [got for got, _ in labels(spark, [f"some words {t} and more" for t in wanted])] == list(wanted.values())


def test_every_template(spark):
    got = labels(spark, [f"left {t} right" for _, t in dl.TEMPLATES])
    assert all(label in found and score == 1 for (label, _), (found, score) in zip(dl.TEMPLATES, got))


def test_shared_wording(spark):
    by = {}
    for label, text in dl.NOTICES:
        by.setdefault(label, []).append(text)
    got = labels(spark, [" xx ".join(by[x]) for x in ("lgpl", "agpl", "unlicense", "isc")])
    assert [found for found, _ in got] == [{"gpl", "lgpl"}, {"agpl", "gpl"}, {"unlicense"}, {"isc"}]
