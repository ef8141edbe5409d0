import hashlib
import re
from collections import Counter

import numpy as np

from dailybars.llm import imatch


def test_fingerprints(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"wörd{i}" for i in range(600)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    rows = [(int(i), prose(rng.integers(1, 120))) for i in rng.choice(5000, 300, replace=False)]
    rows += [(9000, rows[0][1]), (9001, None), (9002, ""), (9003, rows[1][1]), (9003, rows[1][1]), (20_000_000, "only unseen words here"), (None, rows[2][1]), (20_000_001, prose(20_000))]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, chunk int")
    got = imatch.fingerprints(docs, low=0.01, high=0.2).collect()
    assert len(got) == len(rows)
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    texts = [t for _, t in order]
    edited = [t[:len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][:len(t) // 2] for i, t in enumerate(texts)]
    df = Counter(w for t in texts for w in set(t.lower().split()))
    band = {w for w, n in df.items() if 0.01 * len(texts) <= n <= 0.2 * len(texts)}
    part = {r["term"]: r["part"] for r in imatch.lexicon(docs, 0.01, 0.2).collect()}
    assert set(part) == band

    def print_(text):
        words = set(text.lower().split())
        own = {}
        for w in words & band:
            own.setdefault(part[w], []).append(w)
        md5 = lambda ws: hashlib.md5(" ".join(sorted(ws)).encode()).hexdigest()
        return sorted(f"{p:02X}{md5(ws)[:6]}" for p, ws in own.items()) or [md5(words)]

    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    prints = [print_(t) for t in texts]
    want = [(d, len(t), hashlib.sha256(e.encode()).hexdigest(), " ".join(p), " ".join(print_(e)), like(p, print_(e)), like(p, prints[(i + 1) % len(prints)]))
            for i, ((d, t), e, p) in enumerate(zip(order, edited, prints))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    one = imatch.fingerprints(docs.filter("doc_id = 9000")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert imatch.fingerprints(docs.limit(0)).count() == 0


def test_bounded_lexicon(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i}") for i in range(90)], "doc_id long, text string")
    assert imatch.lexicon(docs, 0.0, 1.0, most=9).count() <= 9


def test_texts_are_dealt_out_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i % 9} b{i % 40} c{i}") for i in range(2000)], "doc_id long, text string").repartition(3)
    kept, together = [], imatch._together
    monkeypatch.setattr(imatch, "_together", lambda df, name: kept.append(df) or together(df, name))
    got = imatch.fingerprints(docs, low=0.001, high=0.5)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    kept[0].collect()
    assert "ReusedExchange" in plan(kept[0])  # the texts
    assert len(got.collect()) == 2000
    assert not re.search(r"hashpartitioning\(chunk#\d+L?, place#", plan(got))  # the fingerprints lie by chunk
