import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from dailybars.llm import context_tree

SCHEMA = "doc_id bigint, text string, score string, block int, key string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words = lambda text: re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0


class Tree:
    """Context-tree weighting of bits, node by node."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children, self.weight = depth, defaultdict(lambda: [0, 0]), defaultdict(set), {}
        for text in texts:
            for context, byte in self.bytes(text):
                for bit in range(8):
                    prefix = byte >> (8 - bit) | 1 << bit
                    for d in range(depth + 1):
                        node = (context[depth - d:], prefix)
                        self.counts[node][byte >> (7 - bit) & 1] += 1
                        if d < depth:
                            self.children[node].add((context[depth - d - 1:], prefix))

    def bytes(self, text):
        data = b"".join(w.encode() + b" " for w in words(text)) + b"\n"
        padded = bytes(self.depth) + data
        return [(padded[i:i + self.depth], data[i]) for i in range(len(data))]

    def weighted(self, node):
        """Log of the estimate alone and of the weighted probability of a node's counts."""
        if node not in self.weight:
            a, b = self.counts[node]
            alone = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
            if len(node[0]) == self.depth:
                self.weight[node] = alone, alone
            else:
                below = sum(self.weighted(c)[1] for c in self.children[node])
                top = max(alone, below)
                self.weight[node] = alone, math.log(0.5) + top + math.log(math.exp(alone - top) + math.exp(below - top))
        return self.weight[node]

    def score(self, text):
        total = 0.0
        for context, byte in self.bytes(text):
            for bit in range(8):
                prefix, one, p = byte >> (8 - bit) | 1 << bit, byte >> (7 - bit) & 1, None
                for d in range(self.depth, -1, -1):
                    node = (context[self.depth - d:], prefix)
                    if node not in self.counts:
                        continue
                    n = self.counts[node]
                    here = (n[one] + 0.5) / (sum(n) + 1)
                    if p is not None:
                        alone, whole = self.weighted(node)
                        share = math.exp(math.log(0.5) + alone - whole)
                        here = share * here + (1 - share) * p
                    p = here
                total += math.log10(0.5 if p is None else p)
        return total


def brute(rows, depth):
    train = [t for i, t, *_ in rows if not held(i)]
    c = Counter()
    for t in train:
        c.update([*words(t), None])
    n, v, tree = sum(c.values()), len(c), Tree(train, depth)
    out = []
    for i, t, *_ in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((i, held(i), len(tokens), sum(c[w] > 0 for w in tokens), n, base, tree.score(t)))
    return out


def invented(n, seed=4):
    rnd = random.Random(seed)
    lexicon = ["tea", "Sea", "the", "señor", "and", "hand", "stand", "x", "日本"]
    return [(i, rnd.choice([" ", "\t", "  "]).join(rnd.choices(lexicon, k=rnd.randint(0, 12))), "s", 1, "k") for i in range(n)]


ODD = [(None, "The tea", "s", 1, "k"), (20, None, None, None, None), (21, "", "s", 1, "k"), (21, "", "s", 1, "k"), (22, " \n\t ", "s", 1, "k"), (23, "zzz " * 60 + "q", "s", 1, "k")]


def run(spark, rows, **options):
    got = context_tree.score(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return [tuple(r) for r in got.collect()]


@pytest.mark.parametrize("depth, block_bytes", [(5, 16 << 20), (2, 300)])
def test_equals_a_naive_tree(spark, depth, block_bytes):
    rows = invented(30) + ODD
    order = lambda r: (str(r[0]), r[2], round(r[6], 4))
    got, want = sorted(run(spark, rows, depth=depth, block_bytes=block_bytes), key=order), sorted(brute(rows, depth), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert any(r[1] for r in got) and not all(r[1] for r in got)
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


def test_held_out_text_is_shorter_than_by_words(spark):
    got = [r for r in run(spark, invented(400, 9)) if r[1] and r[2] > 3]
    assert len(got) > 20
    rnd = random.Random(1)
    fresh = [(10_000 + i, "".join(rnd.choices("tehansd", k=40)), "s", 1, "k") for i in range(40)]
    known, new = (sum(r[6] for r in g) / sum(r[2] for r in g) for g in (got, [r for r in run(spark, invented(400, 9) + fresh) if r[0] and r[0] >= 10_000 and r[1]]))
    assert known > new  # words of the corpus are likelier than shuffled letters


def test_no_rows_and_no_training_rows(spark):
    assert run(spark, []) == []
    only = [i for i in range(200) if held(i)][:3]
    got = run(spark, [(i, "ab", "s", 1, "k") for i in only])
    assert {r[:5] for r in got} == {(i, True, 2, 0, 0) for i in only}
    assert all(r[6] == pytest.approx(4 * 8 * math.log10(0.5)) for r in got)
