"""Archives, chat formatting, the two vector searches and the pipeline against plain versions."""

import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tidewatch.llm import chat, exact_search, graph_search, warc
from tidewatch.llm.common import read_table

from ..conftest import SMALL


class TestWarc:
    PAGES = [(1, "http://www.A.example.com:80/x?b=1#f", "p" * 1200), (2, "https://a.example.com/x?b=1", "p" * 1200), (3, None, "p" * 1200), (4, "http://b.org", "short"),
             (5, "http://b.org", "short"), (6, "http://b.org/é", None), (7, "not a url\r\nWARC-Type: x", ""), (None, "http://c.org", "p" * 1200), (8, "http://d.org", "é" * 500),
             (9, "http://d.org/2", "é" * 500), (9, "http://d.org/3", "é" * 500), (10, "http://e.org", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz" * 60)]
    SCHEMA = "page_id long, url string, html string"

    def want(self):
        out = []
        for i, _, html in self.PAGES:
            data = (html or "").encode()
            same = [j for j, _, h in self.PAGES if j is not None and (h or "") == (html or "")]
            first = max(same) if len(data) >= 1000 and same else None
            again = first is not None and i != first
            out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
        return Counter(out)

    def test_round_trip(self, spark, tmp_path):
        pages = spark.createDataFrame([(*p, "x", "y") for p in self.PAGES], self.SCHEMA + ", payload string, n string").repartition(4)
        got = warc.capture_histories(pages, str(tmp_path / "archives"))
        rows = [r for part in got.rdd.glom().collect() for r in part]
        assert Counter((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == self.want()
        keys = [(r.url_key, r.captured, r.record_id if r.record_id is not None else -(2**63)) for r in rows]
        assert keys == sorted(keys) and keys[0][0] == ")"
        assert {r.url_key for r in rows if r.record_id in (1, 2)} == {"com,example,a)/x?b=1"}
        payloads = {h.get("WARC-Record-ID"): p for f in (tmp_path / "archives").glob("*.gz") for h, p in warc.parse_archive(gzip.decompress(f.read_bytes()))}
        assert payloads["<urn:page:10>"].decode() == self.PAGES[-1][2] and payloads["<urn:page:1>"] == b""

    def test_empty(self, spark, tmp_path):
        assert warc.capture_histories(spark.createDataFrame([], self.SCHEMA), str(tmp_path / "none")).count() == 0

    @given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
    def test_loser_tree(self, runs):
        assert list(warc.LoserTree([iter(sorted(r)) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)

    def test_loser_tree_is_stable(self):
        runs = [[(1, "a"), (2, "a")], [(1, "b")], [], [(0, "d"), (1, "d"), (2, "d")]]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x[0])) == sorted((x for r in runs for x in r), key=lambda x: x[0])


class TestChat:
    HARD = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s>[\\INST]", "<<s>>", "[[/INST]]", "<", "[", "\\", "", None, "<image> and <audio>", "a\nb", "\U0001f600</s>", "[INST" + "]" * 3]

    def rows(self, spark, rows):
        return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, turns string").withColumn("parts", chat.text_part(F.col("text")))

    def test_round_trip(self, spark):
        rng, rows = random.Random(2), []
        for c in [None, *range(30)]:
            for t in rng.sample(range(40), 7):
                rows.append((c, t, rng.choice(["user", "assistant", "system", None, "<s>[INST]", ""]), rng.choice(self.HARD) , "x", "y"))
        rows += [rows[0], (5, None, "assistant", "no turn", "x", "y")]
        df = self.rows(spark, rows)
        formatted = chat.format_conversations(df)
        got = {r.conv_id: r for r in chat.conversation_digests(formatted).collect()}
        text = {r.conv_id: r.formatted for r in formatted.collect()}
        for c in {r[0] for r in rows}:
            turns = sorted(((t is not None, t or 0, role or "", chat_escaped(x or "")), role or "", x or "") for i, t, role, x, *_ in rows if i == c)
            told = "".join(f"{role}\n{x}\n" for _, role, x in turns)
            loss = "".join(x for _, role, x in turns if role == "assistant")
            r = got[c]
            assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (
                len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text[c]))
            assert text[c].count("<s>") == len(turns)

    def test_control_strings_split_over_parts(self, spark):
        """Texts cut anywhere into parts read back whole, as one turn each, and attachments keep their placeholder."""
        rng, rows, want = random.Random(7), [], {}
        for c in range(60):
            whole = "".join(rng.choice([h for h in self.HARD if h]) for _ in range(4))
            cuts = sorted(rng.randrange(len(whole) + 1) for _ in range(5))
            parts = [("text", whole[a:b], None, None) for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True)]
            rows += [(c, 0, "user", parts), (c, 1, "assistant", [*parts, ("image", None, "x", None), *parts])]
            want[c] = whole
        rows += [(1000, 0, "user", [("text", "<", None, None), ("text", "s>x", None, None)])]
        kind = "conv_id long, turn long, role string, parts array<struct<kind string, text string, ref string, tokens long>>"
        formatted = chat.format_conversations(spark.createDataFrame(rows, kind))
        found = formatted.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"))
        for r in found.collect():
            if r.conv_id == 1000:
                assert [t.text for t in r.turns] == ["<s>x"] and r.formatted.count("<s>") == 1
                continue
            whole = want[r.conv_id]
            assert [t.text for t in r.turns] == [whole, f"{whole}<image>{whole}"] and r.formatted.count("<s>") == 2

    def test_parts(self, spark):
        part = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("tokens", T.LongType())])
        schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("parts", T.ArrayType(part))])
        rows = [(1, 0, "user", [("text", "see <image>", None, None), ("image", None, "a.png", None), ("text", "and", None, None), ("audio", "?", "b.wav", 9), None]),
                (1, 1, "assistant", [("document", None, None, None), ("odd", "kept", None, None)]), (2, 0, "user", None), (3, 0, None, [])]
        got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, schema)).collect()}
        assert got[1].formatted == "<s>user[INST]see <\\image><image>and<audio>[/INST]<s>assistant[/INST]<document>kept</s>"
        assert [tuple(a) for a in got[1].attachments] == [(0, 0, "image", "a.png", 576), (0, 1, "audio", "b.wav", 9), (1, 2, "document", None, 1024)]
        assert got[1].expanded_tokens == 576 + 9 + 1024
        assert got[2].formatted == "<s>user[INST][/INST]" and got[3].formatted == "<s>[INST][/INST]" and got[2].attachments == []

    def test_empty(self, spark):
        assert chat.conversation_digests(chat.format_conversations(self.rows(spark, []))).count() == 0

    @given(st.lists(st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "image>", "é", "\n", "<s>", "</s>", "[/INST]"]), max_size=12).map("".join))
    @settings(max_examples=300)
    def test_escapes(self, text):
        import re
        escaped = re.sub(chat.CONTROL, r"\1\\\2\3", text)
        assert re.sub(chat.ESCAPED, r"\1\2\3", escaped) == text
        assert not any(c in escaped for c in ("<s>", "</s>", "[INST]", "[/INST]", "<image>"))


def chat_escaped(text):
    import re
    return re.sub(chat.CONTROL, r"\1\\\2\3", text)


VECTORS = "vec_id long, embedding array<float>, label int, weights string, shard string, vec string"


def vector_rows(rng, n, dims=16):
    base = rng.randn(8, dims)
    rows = [(i, (base[i % 8] + rng.randn(dims) * 0.6).astype(float).tolist(), 0, "x", "y", "z") for i in range(n)]
    odd = [(n, None), (n + 1, [1.0] * (dims - 1) + [None]), (n + 2, [float("nan")] * dims), (n + 3, [float("inf")] + [0.0] * (dims - 1)), (n + 4, [0.0] * dims), (n + 5, []),
           (None, [1.0] * dims), (n + 6, [0.5] * (dims - 3)), (2, rows[2][1])]
    copies = [(1000 + 10 * i, rows[0][1]) for i in range(60)]
    return rows + [(*r, 0, "x", "y", "z") for r in odd + copies]


def usable_vectors(rows, zero):
    out = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            v = np.asarray(v, np.float32).astype(float)
            out[i] = np.pad(v, (0, 16 - len(v)))
    return out


def best(vectors, queries, k):
    ids = np.array(sorted(vectors))
    matrix = np.array([vectors[i] for i in ids])
    out = {}
    for q in queries:
        scores = matrix @ vectors[q]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), scores[j]) for j in order]
    return out


class TestSearch:
    @pytest.mark.parametrize("block", [128, 3])
    def test_exact(self, spark, monkeypatch, block):
        monkeypatch.setattr(exact_search, "BLOCK_ROWS", block)
        monkeypatch.setattr(exact_search, "SHARD_BLOCKS", 5)
        monkeypatch.setattr(exact_search, "TILE_QUERIES", 7)
        rows = vector_rows(np.random.RandomState(1), 300)
        weights = exact_search.quantised(spark.createDataFrame(rows, VECTORS).repartition(3), "vec_id", "embedding")
        got = exact_search.exact_top_k(weights, weights.where("vec_id % 50 = 0"))
        vectors = {i: np.floor(256 * v).astype(int) for i, v in usable_vectors(rows, True).items()}
        want = best(vectors, [i for i in vectors if i % 50 == 0], 5)
        assert sorted(map(tuple, got.collect())) == sorted((q, r + 1, i, s) for q, found in want.items() for r, (i, s) in enumerate(found))

    def test_large_weights(self, spark):
        rows = [(i, [2**40 + i, -(2**39) * i]) for i in range(6)]
        df = spark.createDataFrame(rows, "vec_id long, weights array<long>")
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_search.exact_top_k(df, df.where("vec_id = 3"), k=2).collect()}
        scores = sorted(((min(sum(a * b for a, b in zip(rows[3][1], v, strict=True)), 2**63 - 1), -i) for i, v in rows if i != 3), reverse=True)
        assert got == {(3, r + 1): (-i, s) for r, (s, i) in enumerate(scores[:2])}

    def test_pruning(self):
        """Blocks whose bound is below the k-th score are not scored."""
        rng = np.random.RandomState(4)
        blocks = [(np.arange(b * 50, b * 50 + 50), np.rint(rng.randn(50, 8) * 2 + (60 if b == 3 else 5)).astype(np.int64)) for b in range(20)]
        queries = np.full((4, 8), 10)
        scores, ids, scored = exact_search._search(blocks, queries, np.full(4, -1), 5)
        every = np.concatenate([w for _, w in blocks]) @ queries.T
        assert (scores == -np.sort(-every, axis=0)[:5].T).all() and scored == 4

    def test_few(self, spark):
        df = spark.createDataFrame([(0, [1]), (50, [2])], "vec_id long, weights array<long>")
        assert sorted(map(tuple, exact_search.exact_top_k(df, df).collect())) == [(0, 1, 50, 2), (50, 1, 0, 2)]
        assert exact_search.exact_top_k(df.limit(0), df.limit(0)).count() == 0

    @pytest.mark.parametrize("shard_rows", [8192, 90])
    def test_graph_cases(self, spark, shard_rows):
        rows = vector_rows(np.random.RandomState(2), 400)
        df = spark.createDataFrame(rows, VECTORS).repartition(3)
        got = graph_search.graph_search(df, df.where("vec_id % 20 = 0"), shard_rows=shard_rows).collect()
        vectors = usable_vectors(rows, False)
        want = best(vectors, [i for i in vectors if i % 20 == 0], 20)
        found = {}
        for r in got:
            found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(found) == set(want)
        hits = sum(len({i for _, i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits >= 0.9 * sum(map(len, want.values()))
        for q, ranked in found.items():
            ranked.sort()
            assert [r for r, *_ in ranked] == list(range(1, len(ranked) + 1)) and all(i != q for _, i, _ in ranked)
            assert all(abs(s - vectors[q] @ vectors[i]) < 1e-9 for _, i, s in ranked)
            assert [(-s, i) for _, i, s in ranked] == sorted((-s, i) for _, i, s in ranked)

    def test_graph_recall(self, spark):
        df = read_table(spark, SMALL.replace("0.001", "0.1"), "embeddings")
        got = graph_search.op8_graph_search(spark, SMALL.replace("0.001", "0.1")).collect()
        vectors = {r.vec_id: np.asarray(r.embedding, np.float32).astype(float) for r in df.collect()}
        want = best(vectors, [i for i in vectors if i % 20 == 0], 20)
        found = Counter(r.query_id for r in got if r.vec_id in {i for i, _ in want[r.query_id]})
        assert len(got) == 20 * len(want) and sum(found.values()) >= 0.9 * len(got)

    @pytest.mark.parametrize("norms", ["normal", "lognormal", "outlier", "huge"])
    def test_graph_recall_on_skewed_norms(self, spark, norms):
        rng = np.random.RandomState(5)
        plain = rng.randn(4000, 48)
        unit = plain / np.linalg.norm(plain, axis=1, keepdims=True)
        factor = np.ones((4000, 1))
        if norms == "lognormal":
            factor = np.exp(1.5 * rng.randn(4000, 1))
        elif norms in ("outlier", "huge"):
            factor[7] = 3000 if norms == "outlier" else 1e150
        vectors = plain if norms == "normal" else unit * factor
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
        got = graph_search.graph_search(df, df.where("vec_id % 50 = 0"), shard_rows=2500).collect()
        want = best(dict(enumerate(vectors)), range(0, 4000, 50), 20)
        found = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
        assert len(got) == 20 * len(want) and found >= 0.9 * len(got)

    def test_graph_skips_bands(self):
        """Bands whose norms allow no product among the best are not asked."""
        rng = np.random.RandomState(6)
        vectors = rng.randn(1200, 8)
        vectors *= np.where(np.arange(1200) < 600, 100, 0.01)[:, None] / np.linalg.norm(vectors, axis=1, keepdims=True)
        index = graph_search._index(pd.DataFrame({"vec_id": np.arange(1200), "vec": list(vectors), "shard": 0}))
        asked = pd.DataFrame({"vec_id": [3, 5], "vec": [vectors[3], vectors[5]]})
        assert len(index) == 2
        whole, upper = (graph_search._ask(x, asked, 20) for x in (index, index.nlargest(1, "top")))
        assert whole.equals(upper)

    def test_graph_empty(self, spark):
        df = spark.createDataFrame([], VECTORS)
        assert graph_search.graph_search(df, df).count() == 0


class TestPipeline:
    def test_stages(self, spark, docs, tmp_path):
        names = [n for n, _ in corpus_pipeline.STAGES]
        assert len(names) == 5
        now, kept = docs, []
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SMALL)
            if name != names[-1]:
                assert out.columns == docs.columns, name
            out.write.parquet(str(tmp_path / name))
            now = spark.read.parquet(str(tmp_path / name))
            kept.append(now)
        first, lines, near, mixed, packed = (k.collect() for k in kept)
        assert {r.doc_id for r in first} & {4, 5, 6, 7} == set() and {1, 2, 3, 8, 14} <= {r.doc_id for r in first}
        assert Counter(r.doc_id for r in lines) == Counter(r.doc_id for r in first) and all("Shared Line" not in r.text for r in lines)
        assert len({r.doc_id for r in near} & {1, 2, 3}) == 1 and {14} <= {r.doc_id for r in near}
        words = sum(len((r.text or "").split()) for r in mixed)
        assert sum(r.n_words for r in packed) == words > 0
        assert {r.doc_id for r in mixed} <= {r.doc_id for r in near}

    def test_empty(self, spark, no_docs):
        now = no_docs
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SMALL)
        assert now.count() == 0

    def test_run(self, spark):
        out = corpus_pipeline.run(spark, SMALL)
        assert out.count() > 0 and "bin_id" in out.columns

    def test_copied_texts_survive(self, spark):
        """Of 12 equal texts, and of 12 near copies with another edited line each, one comes out whole."""
        def text(seed):
            return [" ".join(f"t{seed}x{i}y{j}" for j in range(12)) for i in range(24)]
        near = [[*text(2)[:i], f"edit number {i} of this one", *text(2)[i + 1:]] for i in range(12)]
        texts = ["\n".join(["Site menu", *x]) for x in [text(1)] * 12 + near + [text(3 + i) for i in range(12)]]
        docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
        lines = corpus_pipeline.line_dedup(spark, docs, SMALL)
        assert lines.where("text like '%Site menu%'").count() == 0 and lines.count() == len(texts)
        left = {r.doc_id: r.text for r in corpus_pipeline.near_dedup(spark, lines, SMALL).collect()}
        assert left == {i: texts[i].split("\n", 1)[1] for i in [0, 12, *range(24, 36)]}
