import random
import re
from collections import Counter, defaultdict

import numpy as np

from dailybars.llm import phrase_graph

SCHEMA = "doc_id bigint, text string, lang string, phrase string, f double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        yield [w for w in re.split("[\x20\x09]+", piece) if w]


def counted(rows):
    f = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for words in pieces(text):
            for k in (1, 2, 3, 4):
                f[lang or "und" if lang is None else lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return f


def brute(rows, least, top):
    out = []
    for lang, f in counted(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        held = defaultdict(int)
        for p, c in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i:i + k]] = max(held[p[i:i + k]], c)
        found = []
        for p, a in candidates.items():
            if p in held and 100 * held[p] >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def run(spark, rows, **options):
    got = phrase_graph.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), cell_bits=18, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def invented(seed, docs=60):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "sea", "río", "x" * 300, "a", "b", "c", "d", "ÄÖ", "äö", "e"]
    weights = [9, 5, 7, 3, 2, 1, 6, 6, 6, 2, 1, 1, 1]
    passage = "one long passage that stands in every copy of it without any stop and is told again"
    rows = []
    for i in range(docs):
        text = "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!", " \r\n"]) for w in rnd.choices(words, weights, k=rnd.randint(0, 90)))
        rows.append((i, text + (passage if i % 2 else "") + ("\x0ba b c a b c a b c a b c" if i % 3 else ""), rnd.choice(["en", "en", "en", "fr", None, "und"]), "x", 1.0))
    return rows


ODD = [(None, None, "en", None, None), (1, "", "en", None, None), (1, " \t ", None, None, None), (2, ".,;:!?\n\r\x0b\x0c", "fr", None, None),
       (3, "the of sea a b", "en", None, None), (3, "the of sea", "en", None, None), (3, "the of sea", "en", None, None)]


def test_equals_brute_force(spark):
    for seed, least, top in ((1, 5, 2000), (2, 3, 7), (3, 1, 40)):
        rows = invented(seed) + ODD
        want = brute(rows, least, top)
        assert len(want) > 15
        assert run(spark, rows, least=least, top=top) == want


def test_crowded_cells_change_nothing(spark):
    """With few cells every word shares one with a frequent word; nothing is cut and counts stay the same."""
    rows = invented(4)
    got = phrase_graph.collocations(spark.createDataFrame(rows, SCHEMA), least=4, cell_bits=4)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4, 2000)


def test_very_long_text_and_no_rows(spark):
    rows = [(1, "deep blue sea " * 200_000, "en", None, None), (2, "deep blue " * 40, None, None, None)]
    assert run(spark, rows) == brute(rows, 30, 2000)
    assert run(spark, []) == []
    assert run(spark, [(1, None, None, None, None)]) == []


def test_counts_are_all_frequent_grams(spark):
    rows = invented(5) + ODD
    counts, words = phrase_graph.graph(spark.createDataFrame(rows, SCHEMA), least=6, cell_bits=18)
    f = counted(rows)
    assert {(r["lang"], r["phrase"]): (r["k"], r["f"]) for r in counts.collect()} == {
        (lang, " ".join(p)): (len(p), c) for lang, of in f.items() for p, c in of.items() if c >= 6}
    assert {r["lang"]: r["n"] for r in words.collect()} == {lang: sum(c for p, c in of.items() if len(p) == 1) for lang, of in f.items()}


def test_paths_are_whole_passages_with_their_edges(spark):
    rows = invented(6)
    counts, _ = phrase_graph.graph(spark.createDataFrame(rows, SCHEMA), least=4, cell_bits=18)
    edges = {(r["lang"], r["phrase"]): r["f"] for r in counts.filter("k = 4").collect()}
    found = [tuple(r) for r in phrase_graph.paths(counts).collect()]
    again = Counter()
    for lang, path, f in found:
        w = path.split(" ")
        for i in range(len(w) - 3):
            again[lang, " ".join(w[i:i + 4])] += 1
            assert edges[lang, " ".join(w[i:i + 4])] == f
    assert set(again) == set(edges) and set(again.values()) == {1}
    passage = [p for lang, p, f in found if lang == "en" and "passage that stands in every copy of it without any stop and is told" in p]
    assert len(passage) == 1
    assert len(found) < len(edges)


def test_words_of_one_hash_stay_apart():
    class Same(phrase_graph.batches.Powers):
        def spans(self, prefix, start, end):
            return np.zeros(len(start), np.uint64)

    body = np.frombuffer(b"ab cd ab c, cd", np.uint8)
    part = phrase_graph.Words(body, np.array([0, len(body)]), np.zeros(1, np.int64), Same())
    assert part.numbers().tolist() == [0, 1, 0, 2, 1]
