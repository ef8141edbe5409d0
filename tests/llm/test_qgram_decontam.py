import numpy as np
import pyarrow as pa

from dailybars.llm import batches, qgram_decontam


def distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.integers(15, 40))) for i in range(8)] + [(90, ""), (91, None), (92, "short")]
    docs = [(0, None), (1, ""), (2, " \n\t "), (3, "short")]
    for i in range(80):
        text = items[i % 8][1]
        kind = i % 4
        if kind == 1:
            text = text.upper().replace(" ", "\n ").replace("É", "é")
        if kind >= 2:
            chars = list(text)
            for _ in range(max(1, int(len(text.encode()) * 0.03)) if kind == 2 else int(len(text) * 0.15)):
                chars[rng.integers(0, len(chars))] = "z"
            text = "".join(chars)
        docs.append((10 + i, f"{prose(rng.integers(0, 60))} {text} {prose(rng.integers(0, 60))}"))
    docs += [(None, items[0][1]), (10, docs[4][1]), (300, items[0][1] + " x " + items[0][1]), (301, " ".join(w for _, w in items[:8]) * 3)]
    plain = lambda t: " ".join((t or "").translate({c: c + 32 for c in range(65, 91)}).split()).encode()
    want = set()
    for d, t in docs:
        for i, text in items[:8]:
            size = len(plain(text))
            if distance(plain(text), plain(t)) <= int(np.ceil(size * qgram_decontam.EDITS)):
                want.add((d, i))
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    marks = spark.createDataFrame(items, "item_id long, text string")
    got = qgram_decontam.passages(frame, marks).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert sum(r["doc_id"] == 300 and r["item_id"] == 0 for r in got) == 2
    r = next(r for r in got if r["doc_id"] == 300)
    assert (r["first_word"], r["last_word"] - r["first_word"] + 1, r["edits"]) == (0, len(items[0][1].split()), 0)
    parts = qgram_decontam.passages(frame, marks, part_bytes=200).collect()
    assert sorted(map(str, parts)) == sorted(map(str, got))
    assert qgram_decontam.passages(frame.limit(0), marks).count() == 0
    assert qgram_decontam.passages(frame, marks.limit(0)).count() == 0


def test_plain():
    out, begin = qgram_decontam.plain(*batches.utf8(pa.array([" Ab  c\n", "", "\t", "É d", None])))
    assert [bytes(out[a:b - 1]).decode() for a, b in zip(begin[:-1], begin[1:])] == ["ab c", "", "", "É d", ""]
