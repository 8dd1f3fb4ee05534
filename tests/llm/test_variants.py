"""Spelling variants, hard negatives and suffix dedup against plain versions."""

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import negatives, repeats, spelling
from tidewatch.llm.suffix_sort import Hashed, _repeated_bytes

from .conftest import document

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_variants(rows, letters=7, count=2, times=10):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOW)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= letters
    n = {w: c for w, c in n.items() if c >= count}
    near = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            less = w[:i] + w[i + 1:]
            if less in n:
                near[w].add(less), near[less].add(w)
    by_gap = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by_gap[w[:i] + "*" + w[i + 1:]].add(w)
    for ws in by_gap.values():
        for w in ws:
            near[w] |= ws - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= times * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w) or "", root(w), n[w], len(near[w]), n[form[w]] if w in form else 0) for w in n)


def got_variants(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


class TestSpelling:
    def cases(self):
        rng = random.Random(4)
        stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["x" * 3000, "x" * 2999, "x" * 2000 + "y" + "x" * 999]
        rows = []
        for i in range(300):
            words = []
            for _ in range(40):
                w = rng.choice(stems[:8] * 10 + stems)
                if rng.random() < 0.2 and len(w) < 100:
                    k = rng.randrange(len(w))
                    w = w[:k] + rng.choice(["", "a", "É", "zz"]) + w[k + rng.randint(0, 1):]
                words.append(w.upper() if rng.random() < 0.1 else w)
            rows.append((i, rng.choice([" ", "1", "-"]).join(words)))
        return rows + [(None, "repeated repeated wordings"), (None, None), (7, ""), (7, "repeated")] + [rows[0]] * 2

    @pytest.mark.parametrize("region", [32768, 20])
    def test_against_plain(self, spark, monkeypatch, region):
        monkeypatch.setattr(spelling, "REGION_WORDS", region)
        monkeypatch.setattr(spelling, "LEAF", 3 if region == 20 else 96)
        rows = self.cases()
        docs = spark.createDataFrame([document(*r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, "
                                     "word string, n string, best string, region string, " + ", ".join(f"x{i} string" for i in range(9)))
        assert got_variants(spelling.spelling_variants(docs.repartition(3))) == plain_variants(rows)

    def test_chain_of_forms(self, spark):
        words = spark.createDataFrame([("abcdefg", 1), ("abcdefgh", 10), ("abcdefghi", 100), ("abcdefghij", 1000), ("abcdefgx", 10)], "word string, n long")
        found = {r.word: (r.form, r.root) for r in spelling.variants(words).collect()}
        assert found == {"abcdefg": ("abcdefgh", "abcdefghij"), "abcdefgh": ("abcdefghi", "abcdefghij"), "abcdefghi": ("abcdefghij", "abcdefghij"),
                         "abcdefghij": (None, "abcdefghij"), "abcdefgx": (None, "abcdefgx")}

    def test_empty(self, no_docs):
        assert spelling.spelling_variants(no_docs).count() == 0


def plain_negatives(rows, anchors, positives=5, k=3, low=50, high=95):
    out = []
    for a, label, v in anchors:
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), i, la == label) for i, la, w in rows if i != a]
        for p, i, _ in sorted(s for s in scored if s[2])[:positives]:
            hard = sorted((s, j) for s, j, same in scored if not same and low * -p <= 100 * -s <= high * -p)[:k]
            out += [(a, i, r, j, -p, -s) for r, (s, j) in enumerate(hard, 1)]
    return sorted(out)


class TestHardNegatives:
    @pytest.mark.parametrize("spread", [2, 40])
    def test_against_plain(self, spark, monkeypatch, spread):
        """Many ties with a small spread; scores of either sign."""
        monkeypatch.setattr(negatives, "SHARD_ROWS", 40)
        monkeypatch.setattr(negatives, "TILE_ANCHORS", 7)
        rng = random.Random(spread)
        rows = [(i, rng.randrange(3), [rng.randint(-spread // 3, spread) for _ in range(rng.choice([3, 4]))]) for i in range(200)]
        rows += [(1000, 9, [5, 5, 5]), (1001, 0, [10**9] * 4), (1002, 1, [10**9 - 3] * 4)]
        df = spark.createDataFrame(rows, "vec_id long, label long, weights array<long>")
        asked = [r for r in rows if r[0] % 4 == 0]
        found = negatives.hard_negatives(df, df.where("vec_id % 4 = 0"))
        assert sorted(tuple(r) for r in found.collect()) == plain_negatives(rows, asked)

    def test_rows_that_take_part(self, spark):
        rows = [(1, [1.0, 2.0], 1, "x"), (1, [0.5, 9.0], 2, "x"), (2, None, 1, "x"), (3, [], 1, "x"), (4, [float("nan"), 1.0], 1, "x"), (5, [1.0, None], 1, "x"),
                (None, [1.0, 1.0], 1, "x"), (6, [1.0, 1.0], None, "x"), (7, [0.0, -0.001], 3, "x"), (8, [float("inf"), 1.0], 1, "x")]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, weights string")
        found = negatives.labelled(df, "vec_id", "embedding", "label").collect()
        assert sorted((r.vec_id, r.label, list(r.weights)) for r in found) == [(1, 2, [128, 2304]), (7, 3, [0, -1])]

    def test_empty(self, spark):
        none = spark.createDataFrame([], "vec_id long, label long, weights array<long>")
        assert negatives.hard_negatives(none, none).count() == 0
        one = spark.createDataFrame([(0, 1, [1])], "vec_id long, label long, weights array<long>")
        assert negatives.hard_negatives(one, one).count() == 0


def plain_removed(rows, length):
    """(id, bytes, removed flags) of distinct rows, in the order of ids; ids must be unique."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                gone[s:s + length] = True
            seen.add(b[s:s + length])
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
        out[i] = (bytes(np.frombuffer(b, np.uint8)[~gone]), [(int(a), int(z)) for a, z in zip(edges[::2], edges[1::2], strict=True)])
    return out


def suffix_cases():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    line, passage, base = text(70), text(400), text(1500)
    rows = []
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 3])):
            copy[rng.randrange(len(copy))] = rng.choice("xyz")
        rows.append("".join(copy))
    rows += [text(60) + passage + text(60) for _ in range(25)] + [text(80) + line + text(80) + line for _ in range(40)]
    rows += ["a" * 5000, "ab" * 900, "a" * 99, "a" * 100, "", None, base * 3, passage[:99], passage[:100], passage[100:260], text(30_000) + base]
    rng.shuffle(rows)
    return rows


class TestSuffixDedup:
    @pytest.mark.parametrize("setting", [{}, {"HOT_CONTEXTS": 3}, {"GROUP_ROWS": 5, "GROUP_BYTES": 700, "STRINGS": 50, "BATCH_BYTES": 3000, "PIECE_BYTES": 500}])
    def test_against_plain(self, spark, monkeypatch, setting):
        for name, value in setting.items():
            monkeypatch.setattr(repeats, name, value)
        rows = [(3 * i - 50, t) for i, t in enumerate(suffix_cases())]
        schema = "doc_id long, text string, lang string, source string, n_chars long, place string, kept string, start string, " + ", ".join(f"x{i} string" for i in range(10))
        docs = spark.createDataFrame([document(*r) for r in rows], schema).repartition(4)
        found = repeats.drop_repeated_bytes(docs)
        assert found.columns == [*docs.columns, "removed", "kept_"]
        want = plain_removed(rows, 100)
        assert {r.doc_id: (bytes(r.kept_), [(x.begin, x.end) for x in r.removed]) for r in found.collect()} == want
        assert found.where("place <> 'x'").count() == 0

    def test_ids_that_are_null_or_repeated(self, spark):
        """Null first, texts with one id in some order, equal rows alike; also ids that are no numbers."""
        a, b, c = ("".join(random.Random(s).choices("abcdefgh", k=300)) for s in (1, 2, 3))
        rows = [(None, a), (None, a), ("1", a + b), ("2", b + c), ("2", "short"), ("3", None), ("3", c + a)]
        found = repeats.drop_repeated_bytes(spark.createDataFrame(rows, "doc_id string, text string"))
        assert sorted((r.doc_id or "", r.text or "", bytes(r.kept).decode()) for r in found.collect()) == sorted(
            [("", a, a), ("", a, a), ("1", a + b, b), ("2", b + c, c), ("2", "short", "short"), ("3", "", ""), ("3", c + a, "")])

    def test_empty(self, no_docs):
        assert repeats.drop_repeated_bytes(no_docs).count() == 0

    def test_hashing_holds_little(self):
        """What the hashing of all strings holds does not grow with the texts of a batch."""
        rng = np.random.RandomState(4)
        texts = [rng.randint(97, 123, 2000).astype(np.uint8) for _ in range(2100)] + [rng.randint(97, 123, 4_300_000).astype(np.uint8)]
        tracemalloc.start()
        try:
            for some in repeats.pieces_of(texts, 100):
                repeats.anchored(some, 100, np.zeros(0, np.uint64))
            assert tracemalloc.get_traced_memory()[1] < 150e6
        finally:
            tracemalloc.stop()

    def test_sort(self):
        rng = np.random.RandomState(3)
        data = rng.randint(97, 99, 4000).astype(np.uint8)
        at = rng.randint(0, 3900, 700)
        size = rng.randint(1, 90, 700)
        segment = np.sort(rng.randint(0, 25, 700))
        order = Hashed(data).sort(at, size, segment)
        strings = [(s, data[a:a + n].tobytes(), i) for i, (a, n, s) in enumerate(zip(at, size, segment, strict=True))]
        assert [strings[i] for i in order] == sorted(strings)

    def test_collisions_are_told_by_bytes(self, monkeypatch):
        """With hashes that call everything equal the result is the same."""
        data = np.random.RandomState(5).randint(97, 99, 500).astype(np.uint8)
        at, segment = np.arange(0, 480), np.repeat([0, 1], 240)
        right = Hashed(data).repeated(at, 8, segment)
        view = np.lib.stride_tricks.sliding_window_view(data, 8)
        assert (right == _repeated_bytes(view, at, segment)).all() and right.any() and not right.all()
        monkeypatch.setattr(Hashed, "common", lambda self, a, b, most: np.asarray(most).astype(np.int64))
        assert (Hashed(data).repeated(at, 8, segment) == right).all()
