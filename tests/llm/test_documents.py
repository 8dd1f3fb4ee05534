"""Operators on documents against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import forest, langid, lines, mixing, packing, passages, tiles
from tidewatch.llm import shingles as hashed
from tidewatch.llm.common import read_table, whole_groups
from tidewatch.llm.components import components

from ..conftest import SMALL
from .conftest import document, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text, length):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + length]) for i in range(max(1, len(w) - length + 1)))


def classes(texts, length, percent):
    """For each text the indices of its class, all pairs tested."""
    sets, group = [shingles(t, length) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group, sets


def against_sql(df, sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toArrow())
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def near_cases(seed, families=6, size=14):
    rng, out = random.Random(seed), []
    for f in range(families):
        base = words(500 + f, 80).split()
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


def check_groups(df, texts, ids, length, percent, named):
    group, sets = classes(texts, length, percent)
    least = defaultdict(list)
    for i, g in zip(ids, group, strict=True):
        if i is not None:
            least[g].append(i)
    want = Counter((i, len(s), (min(least[g]) if least[g] else None) if s else i) for i, g, s in zip(ids, group, sets, strict=True))
    assert Counter((r.doc_id, r[named], r.component_id) for r in df.collect()) == want


class TestNearDuplicates:
    def test_cases(self, docs, rows):
        found = forest.near_groups(docs, length=3, percent=85)
        check_groups(found, [r[1] for r in rows], [r[0] for r in rows], 3, 85, "n_shingles")

    @pytest.mark.parametrize("region", [2048, 3])
    def test_families(self, spark, monkeypatch, region):
        """Also with regions and tiles so small that they are cut."""
        monkeypatch.setattr(forest, "REGION_ROWS", region)
        monkeypatch.setattr(tiles, "TILE_MEMBERS", region)
        texts = near_cases(3)
        df = spark.createDataFrame([document(i, t) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, "
                                   + ", ".join(f"x{i} string" for i in range(13)))
        check_groups(forest.near_groups(df, length=3, percent=85), texts, list(range(len(texts))), 3, 85, "n_shingles")

    def test_one_of_each_stays(self, docs, rows):
        left = forest.drop_near_duplicates(docs)
        assert left.columns == docs.columns
        group, sets = classes([r[1] for r in rows], 5, 80)
        kept = Counter(r.doc_id for r in left.collect())
        want = Counter(r[0] for r, s in zip(rows, sets, strict=True) if not s)
        for g in {g for g, s in zip(group, sets, strict=True) if s}:
            want[min((r[0] for r, x in zip(rows, group, strict=True) if x == g), key=lambda i: (i is None, i or 0))] += 1
        assert kept == want

    def test_classes_are_told_by_texts(self, spark):
        """Unlike texts with one id both stay, near copies without ids leave one."""
        a, b = words(21, 100), words(22, 100)
        rows = [(5, a), (5, b), (6, b + " more"), (None, words(23, 90)), (None, words(23, 90) + " more")]
        left = forest.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id or 0, r.text.split()[0]) for r in left) == sorted([(5, a.split()[0]), (5, b.split()[0]), (0, words(23, 90).split()[0])])

    def test_empty(self, no_docs):
        assert forest.near_groups(no_docs).count() == 0 and forest.drop_near_duplicates(no_docs).count() == 0

    def test_components(self, spark):
        rng = random.Random(5)
        edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 40)]
        found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        group = {n: n for e in edges for n in e if e[0] != e[1]}
        for _ in range(100):
            for a, b in edges:
                if a != b:
                    group[a] = group[b] = min(group[a], group[b])
        assert found == group


class TestLines:
    def test_cases(self, docs):
        found = lines.dedup_lines(docs.select("doc_id", "text"))
        against_sql(found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")), lines.OP9_SQL, docs)

    def test_columns_stay(self, docs):
        found = lines.dedup_lines(docs)
        assert found.columns == docs.columns + ["n_lines_", "n_dropped"]
        assert found.where("doc_id = 105").first().text == words(1005, 20)

    def test_rows_count_as_documents(self, spark):
        """Ten rows without id, ten equal rows, and nine of each: as in the SQL."""
        rows = [(None, "Ten nameless\nown")] * 10 + [(5, "ten equal\n ten EQUAL\nother")] * 10 + [(None, "nine nameless")] * 9 + [(6, "nine equal\nnine equal")] * 9
        docs = spark.createDataFrame([document(*r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"x{i} string" for i in range(13)))
        found = lines.dedup_lines(docs.repartition(5))
        against_sql(found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")), lines.OP9_SQL, docs)
        assert found.where("n_dropped > 0").count() == 20

    def test_many_lines(self, spark):
        """One text of 100,000 lines, and lines to drop far apart."""
        long = "\n".join("Common" if i % 997 == 0 else f"line {i}" for i in range(100_000))
        docs = spark.createDataFrame([(0, long)] + [(i, f"own {i}\ncommon ") for i in range(1, 10)], "doc_id long, text string")
        got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
        assert got[0].n_dropped == 101 and got[0].text == "\n".join(x for x in long.split("\n") if x != "Common") and got[3].text == "own 3"

    def test_first_occurrence_stays(self, spark):
        rows = [(i, "\n".join(["Top", f"own {i}", " top ", "x" * (i % 2)] * 40)) for i in range(12)]
        got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=True).collect()}
        seen, common = set(), {"top", "x"} & {"top"}  # x is in six documents
        for i, text in rows:
            want = []
            for line in text.split("\n"):
                key = line.strip(" \t\n\x0b\x0c\r").translate(LOW)
                if key in common and key in seen:
                    continue
                seen.add(key)
                want.append(line)
            assert got[i] == "\n".join(want)

    def test_empty(self, no_docs):
        assert lines.dedup_lines(no_docs).count() == 0


class TestMix:
    def test_cases(self, docs):
        found = mixing.mix_sources(docs)
        against_sql(found.select("doc_id", "size", "source_size", "target", "taken"), mixing.OP4_SQL, docs)

    def test_targets_are_met(self, docs):
        rows = mixing.mix_sources(docs).collect()
        assert all(r.taken <= 3 * r.size for r in rows)
        taken, targets = Counter(), {}
        for r in rows:
            taken[r.source] += r.taken
            targets[r.source] = r.target
        assert all(abs(taken[s] - t) <= 2 for s, t in targets.items())
        assert Counter(rows) == Counter(mixing.mix_sources(docs.repartition(5)).collect())

    def test_clamps(self, spark):
        sizes = [("a", 10.0, 1.0), ("b", 1000.0, 2.0), ("c", 5.0, 3.0), ("d", 400.0, 1.0)]
        df = spark.createDataFrame(sizes, "source string, size double, weight double")
        got = {r.source: r.target for r in mixing.water_fill(df, 1415.0).collect()}
        left, open_ = 1415.0, {s: (z, w) for s, z, w in sizes}
        want = {}
        while over := [s for s, (z, w) in open_.items() if left * w / sum(x for _, x in open_.values()) > 3 * z]:
            for s in over:
                want[s] = 3 * open_[s][0]
            for s in over:
                left -= want[s]
                del open_[s]
        want |= {s: left * w / sum(x for _, x in open_.values()) for s, (_, w) in open_.items()}
        assert got == pytest.approx(want)

    def test_rows_are_repeated(self, docs):
        mixed, taken = mixing.mixed_documents(docs), mixing.mix_sources(docs)
        assert mixed.columns == docs.columns
        copies = Counter(r.doc_id for r in mixed.collect())
        for r in taken.groupBy("doc_id").agg(F.sum("taken").alias("t"), F.max("size").alias("z"), F.count("*").alias("n")).collect():
            assert copies[r.doc_id] >= r.n if r.z == 0 else abs(copies[r.doc_id] - r.t / r.z) <= r.n

    def test_empty(self, no_docs):
        assert mixing.mix_sources(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def plain_best_fit(sizes, sources, clusters, capacity, per_source):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(room, i) for i, (room, held) in enumerate(bins) if room >= size and (c is None or all(c != x for _, x in held))
                and (s is None or sum(s == x for x, _ in held) < per_source)]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append([capacity, []])
        bins[i][0] -= size
        bins[i][1].append((s, c))
        out.append(i)
    return out


class TestPack:
    @pytest.mark.parametrize("seed", range(4))
    def test_best_fit(self, seed):
        rng = random.Random(seed)
        n = 400
        sizes = sorted((rng.randint(1, 60) for _ in range(n)), reverse=True)
        sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in range(n)]
        clusters = [rng.choice(["k", "k", None, *map(str, range(300))]) for _ in range(n)]
        assert packing.best_fit(sizes, sources, clusters, 100, 2) == plain_best_fit(sizes, sources, clusters, 100, 2)

    @pytest.mark.parametrize("shard_rows", [20_000, 5])
    def test_cases(self, docs, rows, shard_rows):
        got = packing.pack_documents(docs, capacity=256, per_source=2, shard_rows=shard_rows).collect()
        sizes, spans = Counter(), defaultdict(list)
        for r in rows:
            sizes[r[0]] += len(WORD.findall(r[1] or ""))
        for r in got:
            spans[r.doc_id].append((r.start_word, r.n_words))
        assert {d: sum(n for _, n in s) for d, s in spans.items()} == dict(sizes)
        assert len([r for r in got if r.bin_id is None]) == sum(1 for r in rows if not WORD.findall(r[1] or ""))
        fill, texts = Counter(), defaultdict(list)
        by_id = {r[0]: r for r in rows}
        for r in got:
            if r.bin_id is not None:
                fill[r.bin_id] += r.n_words
                if r.n_words < 256:
                    texts[r.bin_id].append(by_id[r.doc_id])
        assert all(n <= 256 for n in fill.values()) and all(r.bin_words == fill[r.bin_id] for r in got if r.bin_id is not None)
        for held in texts.values():
            named = [r for r in held if r[0] is not None]
            assert len({r[1] for r in named}) == len(named) and max(Counter(r[3] for r in named if r[3]).values(), default=0) <= 2

    def test_empty(self, no_docs):
        assert packing.pack_documents(no_docs).count() == 0


class TestTiles:
    def test_pairs_of_many_groups(self):
        """Sets of small groups, compared together, are linked as each group alone; repeats within a set don't count."""
        rng = random.Random(5)
        sets, group = [], []
        for g in range(60):
            base = [rng.randrange(300) for _ in range(rng.randrange(1, 40))]
            for _ in range(rng.randrange(1, hashed.FEW + 1)):
                sets.append([x if rng.random() < 0.95 else rng.randrange(300) for x in base] + base[:rng.randrange(3)])
                group.append(g)
        a, b = hashed.similar_pairs(np.array([x for s in sets for x in s], np.uint64), np.array([len(s) for s in sets]), np.array(group), 80)
        want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if group[i] == group[j]
                and 100 * len({*sets[i]} & {*sets[j]}) >= 80 * len({*sets[i]} | {*sets[j]})}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want) > 50

    def test_sets_of_many_texts(self):
        texts = [None, "", " \n", "a b", "a B c", "é a b c a b c", words(3, 500), words(4, 70_000), "x"] * 2
        counts, values = hashed.shingle_sets(texts, 3)
        ends = np.cumsum(counts)
        assert all(np.array_equal(np.unique(values[e - n:e]), hashed.shingle_set(t, 3)) for t, n, e in zip(texts, counts, ends, strict=True))

    def test_window_hashes(self):
        """Every length gives the polynomial of the run."""
        hashes = np.random.RandomState(1).randint(0, 2**63, 80).astype(np.uint64)
        for n in range(1, 40):
            total = np.full(81 - n, n, np.uint64)
            for i in range(n):
                total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[i:81 - n + i]
            assert np.array_equal(hashed.window_hashes(hashes, n), hashed.mixed(total))

    def test_whole_groups(self):
        keys = sorted(random.Random(2).choices(range(40), k=500))
        for width, size in ((7, 1), (7, 200), (100, 900), (500, 300), (1, 64), (60, 1 << 20)):
            batches = [pa.record_batch({"key": pa.array(keys[i:i + width], pa.int64())}) for i in range(0, 500, width)]
            got = [t.column("key").to_pylist() for t in whole_groups(batches, "key", size)]
            assert [k for t in got for k in t] == keys and all(x[-1] != y[0] for x, y in pairwise(got))
            assert size != 1 or len(got) == len(set(keys))


class TestPassages:
    def test_cases(self, spark, docs):
        got = passages.repeated_passages(docs).collect()
        spread = defaultdict(set)
        for r in got:
            spread[r.class_id].add(r.doc_id)
        assert all(len(s) > 1 for s in spread.values())
        flagged = {r.doc_id for r in got}
        assert {1, 2, 3, 8, 9, 14} <= flagged and not flagged & {4, 5, 6, 7, 10, 11, 12, 13} and not flagged & set(range(100, 112))

    def test_passages_anywhere(self, spark):
        """Every run of 50 words that two texts share is found, whatever stands around it; clean texts are left alone."""
        shared = words(9, 51)
        texts = [f"{words(100 + i, i % 7 + 3)} {shared} {words(200 + i, 40)}" for i in range(9)] + [words(300 + i, 90) for i in range(9)]
        got = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        assert {r.doc_id for r in got if r.kind == "passage"} == set(range(9)) == {r.doc_id for r in got}
        assert {r.doc_id for r in got if r.removed} == set(range(1, 9)) and all(r.removed == (r.doc_id != r.first_id) for r in got)
        for r in got:
            assert set(texts[r.doc_id].split()[r.start_word:r.start_word + r.n_words]) <= set(shared.split())

    def test_paragraphs(self, spark):
        texts = [t for t in near_cases(8, families=3, size=10)]
        rows = [(i, f"{words(900 + i, 45)}\n{t}\n{words(950 + i, 45)}") for i, t in enumerate(texts)]
        got = [r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.kind == "paragraph"]
        group, _ = classes(texts, 5, 80)
        size = Counter(group)
        assert {r.doc_id for r in got} == {i for i, g in enumerate(group) if size[g] > 1}
        assert {(r.doc_id, r.first_id) for r in got} == {(i, min(j for j, h in enumerate(group) if h == g)) for i, g in enumerate(group) if size[g] > 1}

    def test_whole_runs_in_every_place(self, spark):
        """The removed passages are just the later copies of a run, to its ends, three times in one document as well."""
        run, longer, twice = words(60, 60), words(61, 12), " ".join(["again"] * 150)
        own = [words(70 + i, 25 + i) for i in range(20)]
        texts = [f"{own[0]} {run} {own[1]}", f"{own[2]} {run} {own[3]} {run} {own[4]} {run} {own[5]}", f"{own[6]} {longer} {run} {longer} {own[7]}",
                 f"{own[8]} {longer} {run} {longer} {own[9]}", f"{own[10]} {twice}", f"{own[11]} {twice} {own[12]}", f"{words(99, 50)}", f"{own[13]} {words(99, 50)} {own[14]}"]
        got = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        gone = defaultdict(set)
        for r in got:
            if r.kind == "passage" and r.removed:
                gone[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
        a = [25 + i for i in range(20)]
        want = {1: {p + i for p in (a[2], a[2] + 60 + a[3], a[2] + 120 + a[3] + a[4]) for i in range(60)}, 2: set(range(a[6] + 12, a[6] + 72)),
                3: set(range(a[8], a[8] + 84)), 5: set(range(a[11], a[11] + 150)), 7: set(range(a[13], a[13] + 50))}
        assert {d: s for d, s in gone.items() if d != 4} == want
        assert len(set(range(a[10], a[10] + 150)) - gone[4]) >= 32

    def test_short_and_wrapped_paragraphs(self, spark):
        """Lines of five words or more, and hard-wrapped paragraphs with an edit and other line ends."""
        body = words(40, 60).split()
        other = [*body[:20], "edited", *body[21:]]
        def wrap(w, n):
            return "\n".join(" ".join(w[i:i + n]) for i in range(0, len(w), n))
        texts = [f"{words(41, 30)}\n\n{wrap(body, 13)}\n\n{words(42, 30)}", f"{words(43, 30)}\n \n{wrap(other, 11)}\n\n{words(44, 30)}",
                 f"{words(45, 30)}\nfive words are enough here\n{words(46, 20)}", f"{words(47, 30)}\n{words(48, 20)}\nFive words are enough here",
                 words(49, 20), words(49, 20), f"{words(50, 30)}\nfour words are not", f"{words(51, 30)}\nfour words are not"]
        got = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        want = {(0, 30, 60, False), (1, 30, 60, True), (2, 30, 5, False), (3, 50, 5, True), (4, 0, 20, False), (5, 0, 20, True)}
        assert {(r.doc_id, r.start_word, r.n_words, r.removed) for r in got if r.kind == "paragraph"} == want

    def test_texts_hashed_together(self):
        """A batch of texts gives what each text gives alone."""
        rng = random.Random(6)
        texts = [None, "", "\n", "a b", "é " * 40, *["".join(rng.choice(["a ", "b ", "dé ", "\n", "\n\n", "x y z w v "]) for _ in range(n)) for n in (5, 30, 60, 200, 900)] * 3]
        counts, rows, chosen, starts, keys = passages._units(texts, 4)
        alone = [passages._units([t], 4) for t in texts]
        assert counts.tolist() == [n for a in alone for n in a[0]] and chosen.tolist() == [n for a in alone for n in a[2]] and counts.sum() > 100 and chosen.sum() > 30
        for i, row in enumerate(rows):
            assert row.tolist() == [x for a in alone for x in a[1][i].tolist()]
        assert starts.tolist() == [x for a in alone for x in a[3].tolist()] and keys.tolist() == [x for a in alone for x in a[4].tolist()]

    @pytest.fixture
    def surrounded(self, spark):
        """Runs with own and shared words beside them, null ids, equal rows and a run that comes again in its document."""
        run, beside = words(500, 50), [words(501 + i, 17) for i in range(3)]
        rows = [(None if i == 7 else i // 2 * 2 if i > 15 else i, f"{words(600 + i, 20 + i)} {beside[i % 3]} {run} {beside[i % 2]} {words(700 + i, i)}") for i in range(20)]
        rows += [(30, f"{run} {beside[0]} {run} {beside[0]}"), (31, run), (31, run), (32, f"{beside[1]} {run}"), (33, None)]
        return spark.createDataFrame(rows, "doc_id long, text string")

    def test_surroundings_in_tasks_and_by_joins(self, surrounded, monkeypatch):
        """Passages with few and with many places are made longer alike, whichever way is taken for them."""
        got = []
        for crowd in (passages.CROWD, 12, 0):
            monkeypatch.setattr(passages, "CROWD", crowd)
            got.append(Counter(map(tuple, passages.repeated_passages(surrounded).collect())))
        assert got[0] == got[1] == got[2] and max(r[3] for r in got[0] if r[1] == "passage") > 50

    def test_tables_of_the_extension(self, surrounded, monkeypatch):
        """Nothing that is written has a row for each word beside a passage."""
        rows, settled = {}, passages.settled

        def counted(df, purpose):
            table = settled(df, purpose)
            rows[purpose] = table.count()
            return table
        monkeypatch.setattr(passages, "settled", counted)
        passages.repeated_passages(surrounded).collect()
        assert rows["passage-anchors"] >= 20 and max(rows.values()) <= rows["passage-anchors"]

    def test_shared_lengths(self):
        """Against a plain version: random words beside places of three passages, several to a document."""
        rng = random.Random(3)
        for _ in range(30):
            places = sorted({(rng.randrange(3), rng.randrange(5), rng.randrange(40)) for _ in range(25)})
            beside = [[rng.choice([7, 7, 7, 8]) for _ in range(rng.randrange(passages.REACH + 1))] for _ in places]
            array = pa.array([np.array(b, np.uint64).tobytes() for b in [[1], *beside]], pa.binary())[1:]
            got = passages._shared_lengths(np.array([p[0] for p in places]), np.array([p[1] for p in places]), array)
            for i, (p, own) in enumerate(zip(places, beside, strict=True)):
                groups = [[q for q, b in zip(places, beside, strict=True) if q[0] == p[0] and b[:n] == own[:n] and len(b) >= n] for n in range(1, len(own) + 1)]
                shared = [(n, g) for n, g in enumerate(groups, 1) if len({q[1] for q in g}) > 1]
                assert got[0][i] == max([n for n, _ in shared], default=0) and got[1][i] == max([n for n, g in shared if g[0] != p], default=0)

    def test_equal_paragraphs_give_bands_once(self, spark):
        """Copies of a line in one batch send its bands on once."""
        docs = spark.createDataFrame([(i, "one line that all of them have") for i in range(50)], "doc_id long, text string").coalesce(1)
        found = [r.paragraphs[0] for r in passages.units(docs, 4).collect()]
        assert len(found) == 50 and len({p.key for p in found}) == 1 and [len(p.bands) for p in found] == [4] + [0] * 49

    def test_bands(self):
        assert 1 - (1 - 0.8**3) ** passages.tuned_bands() >= 0.999 > 1 - (1 - 0.8**3) ** (passages.tuned_bands() - 1)

    def test_empty(self, no_docs):
        assert passages.repeated_passages(no_docs).count() == 0


class TestLanguage:
    def test_held_out_accuracy(self, spark):
        docs = read_table(spark, SMALL.replace("0.001", "0.01"), "documents")
        found = langid.identify(docs).alias("f").join(docs.alias("d"), "doc_id")
        row = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg("score"), F.min("score"), F.max("score")).first()
        assert row[0] > 0.97 and abs(row[1] - row[0]) < 0.05 and 0 <= row[2] and row[3] <= 1

    def test_cases(self, docs, rows):
        got = langid.identify(docs).collect()
        assert len(got) == len(rows)
        und = {r.doc_id for r in got if r.lang_pred == "und"}
        assert {4, 5, 6, 7} <= und and not und & {1, 8, 11} and all(0 <= r.score <= 1 for r in got)

    def test_nothing_to_learn(self, docs, no_docs):
        assert langid.identify(no_docs).count() == 0
        unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
        assert {(r.lang_pred, r.score) for r in langid.identify(unlabelled).collect()} == {("und", 0.0)}

    def test_pieces(self, monkeypatch):
        text = words(5, 400) + " ÀÉ\U0001f600"
        want = langid.counts(text)
        monkeypatch.setattr(langid, "PIECE", 97)
        got = langid.counts(text)
        assert (want[0] == got[0]).all() and (want[1] == got[1]).all()
        assert want[1].sum() == sum(len(text) + 2 - n + 1 for n in langid.ORDERS)

    def test_temperature(self):
        import numpy as np
        rng = np.random.RandomState(0)
        logits = rng.randn(4000, 3)
        labels = np.array([rng.choice(3, p=p) for p in langid.softmax(logits)])
        assert abs(langid.best_temperature(logits * 4, labels) - 4) < 0.6


