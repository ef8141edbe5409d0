import hashlib
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from dailybars.llm import markov_secrets as ms

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plainly(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


@given(st.lists(st.sampled_from(["token", "TOKEN", "Api_Key", "ſecret", "toKen", "=", ": ", "'", '"', "passwd", "abc", "0123456789abcdef", "AKIA", "AKIAABCDEFGHIJKLMN", "é", "İ", " ", "Zz9", "secret"]), max_size=20))
@settings(max_examples=500, deadline=None)
def test_base_spans(parts):
    text = "".join(parts)
    assert [s[:3] for s in ms.base_spans(text)] == plainly(text)


def test_models_and_rows(spark):
    rng = np.random.default_rng(4)
    chars = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    secret = lambda n=32: "".join(rng.choice(chars, n))
    words = ["entitlement", "configuration", "international", "descriptions", "nationally", "get_user_id", "profile_name", "of_the", "user_data", "ization_of", "_description", "Total", "USA"]
    rows = [(i, " ".join(rng.choice(words, 40)) + (f" token = {secret()}" if i % 2 else ""), "a") for i in range(200)]
    hidden, plain = [secret() for _ in range(40)], ["internationalization_of_descriptions", "get_user_description_name_internationally"]
    rows += [(1000 + i, f"id {s} end", "a") for i, s in enumerate(hidden)] + [(2000 + i, f"id {s} end", "a") for i, s in enumerate(plain)]
    rows += [(None, None, None), (5000, "", None), (7, rows[7][1], "a"), (6000, "0123456789abcdef" * 3000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = ms.scan(docs).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 7 for r in got) == 2
    found = {r["doc_id"]: r for r in got}
    assert sum("markov" in found[1000 + i]["spans"] for i in range(40)) >= 38
    assert not any(found[2000 + i]["spans"] for i in range(2))
    text = dict((r[0], r[1]) for r in rows)
    for r in got:
        base = plainly(text[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert r["n_assign"] == sum(b[0] == "assign" for b in base)
    assert ms.scan(docs.limit(0)).count() == 0 and ms.scan(docs.filter("doc_id = 2000")).count() == 1
