"""The piece transducers against the original library and brute force; the language model against sums over all segmentations."""

import math
import random
import struct
import zlib
from collections import Counter

import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import lm, sentencepiece as own  # noqa: E402
from graphloom.llm.pieces import SPACE, UNKNOWN_PENALTY, Normaliser, Pieces, _fields  # noqa: E402
from tests.llm import edges  # noqa: E402

SF = "/root/testdata/sf0.001"
RAW = open(own.MODEL, "rb").read()


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(RAW)
    m.trainer_spec.model_type = 1  # the same pieces and scores, read as weights of paths
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_shortest_paths_match_the_library(library):
    pieces = Pieces(RAW)
    words = "the with hello nterti unbelievable Größe straße éléphant ciónmente x1y2 a.b,c lower_case Thnt".split()
    for word, raw in zip(words, pieces.paths([" " + w for w in words]), strict=True):
        ids = list(struct.unpack(f"<{len(raw) // 4}i", raw))
        score = lambda xs: sum(pieces.score[i] for i in xs)
        best = [library.piece_to_id(p) for p in library.nbest_encode(word, nbest_size=2, out_type=str)[0]]
        assert ids == best or score(ids) == score(best), word


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_normaliser_matches_the_library(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    n = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(n.serialized_model_proto())
    own_ = Normaliser(dict(_fields(m.normalizer_spec.SerializeToString())))
    rng = random.Random(1)
    for _ in range(2000):
        x = "".join(rng.choice("aÀ①ﬁＡ　\t\n é ｶﾞ が㍿Ωſ ½²  Ⅷ​ ßİ") for _ in range(rng.randrange(12)))
        assert own_(x).replace(" ", SPACE) == n.normalize(x), x


def enumerate_paths(pieces, s, at=0):
    """All segmentations of s as lists of ids: pieces, and the bytes of characters that are no piece."""
    if at == len(s):
        yield []
        return
    known = {p: i for i, p in enumerate(pieces.text)}
    arcs = [(end, [known[s[at:end]]]) for end in range(at + 1, len(s) + 1) if s[at:end] in known and pieces.kind[known[s[at:end]]] == 1]
    if not any(end == at + 1 for end, _ in arcs):
        arcs.append((at + 1, [known[f"<0x{b:02X}>"] for b in s[at].encode()]))
    for end, ids in arcs:
        for rest in enumerate_paths(pieces, s, end):
            yield [*ids, *rest]


WORDS = ("the", "with", "cat", "ende", "is", "a\u0e01b", "😀x", "日x")


def test_shortest_path_and_marginal_by_brute_force():
    pieces = Pieces(RAW)
    fallback = UNKNOWN_PENALTY - min(s for s, k in zip(pieces.score, pieces.kind) if k == 1)
    for word, raw, marginal in zip(WORDS, pieces.paths([" " + w for w in WORDS]), pieces.marginals(list(WORDS)), strict=True):
        paths = list(enumerate_paths(pieces, SPACE + word))

        def cost(path):
            chars = sum(1 for i in path if pieces.kind[i] == 6 and int(pieces.text[i][3:5], 16) & 0xC0 != 0x80)
            return sum(-pieces.score[i] for i in path if pieces.kind[i] == 1) + chars * fallback

        assert cost(list(struct.unpack(f"<{len(raw) // 4}i", raw))) == min(map(cost, paths))
        assert marginal == pytest.approx(math.log10(sum(math.exp(sum(pieces.log[i] for i in p)) for p in paths)))


def test_paths_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde thé▁😀").replace(" ", "x") for _ in range(rng.choice([3, 40, 700]))) for _ in range(40)]
    whole = Pieces(RAW)
    paths, marginals = whole.paths([" " + w for w in words]), whole.marginals(words)
    monkeypatch.setattr("graphloom.llm.pieces.CHUNK", 64)
    assert whole.paths([" " + w for w in words]) == paths
    assert whole.marginals(words) == pytest.approx(marginals)


def test_weights_sum_to_one():
    pieces = Pieces(RAW)
    assert sum(math.exp(x) for x in pieces.log if x > -math.inf) + math.exp(pieces.end_log) == pytest.approx(1.0)


def test_round_trip(spark):
    texts = ["", " ", "  a  b ", "x", "日本語テキスト", "😀 hi", "a\tb\nc", "▁x ▁▁", "привет мир 123", "\u0000\u0001", edges.LONG, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    from pyspark.sql import functions as F

    encoded = own.encode(df, {"doc_id": F.col("doc_id")})
    back = {r.doc_id: r.text for r in own.decode(encoded, ["doc_id"]).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    digest = {r.doc_id: r for r in own.digest(df, {"doc_id": F.col("doc_id")}).collect()}
    for r in encoded.collect():
        d = digest[r.doc_id]
        if r.ids is None:
            assert d.n_pieces is None and d.round_trip is None
        else:
            assert d.round_trip and d.n_pieces == len(r.ids) and d.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))


def test_digest_decodes_the_ids(spark):
    """What is said of a text comes from its ids: those of another text, or of bytes that are no UTF-8, do not give it back."""
    from pyspark.sql import functions as F

    df = spark.sql("select * from values (1, X'6120e282ac'), (2, X'ff61'), (3, X''), (4, null), (5, X'e296812078') as t(doc_id, raw)").selectExpr("doc_id", "cast(raw as string) text")
    digest = {r.doc_id: r.round_trip for r in own.digest(df, {"doc_id": F.col("doc_id")}).collect()}
    assert digest == {1: True, 2: False, 3: True, 4: None, 5: True}
    coded = own.encode(df, {"doc_id": F.col("doc_id"), "text": F.col("text")}).where("doc_id in (1, 5)")
    swapped = coded.withColumn("ids", F.when(F.col("doc_id") == 1, F.slice("ids", 1, 1)).otherwise(F.col("ids")))
    rows = {r.doc_id: r for r in own.judged(swapped, ["doc_id"]).collect()}
    assert not rows[1].round_trip and rows[1].n_pieces == 1 and rows[5].round_trip and rows[5].n_bytes == 3


def test_query_edges(spark, tmp_path):
    at = edges.sf_dir(spark, tmp_path, documents=edges.documents(spark))
    rows = own.query(spark, at).collect()
    assert len(rows) == 12 and all(r.round_trip in (True, None) for r in rows)
    assert own.query(spark, edges.sf_dir(spark, tmp_path / "none")).count() == 0


def test_lm_base_and_model_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    counts, vocabulary = Counter(), set()
    for d in docs:
        vocabulary |= set(lm.tokens(d.text.encode()))
        if zlib.crc32(str(d.doc_id).encode()) % 10:
            counts.update(lm.tokens(d.text.encode()))
    n, v = sum(counts.values()), len(counts)
    pieces = Pieces(RAW)
    n1, n2 = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = n1 / (n1 + 2 * n2)
    words = [w for w in vocabulary if w]
    logs = dict(zip(words, pieces.marginals([w.decode() for w in words]), strict=True)) | {b"": pieces.end_log / math.log(10)}
    lattice = {w: 10**x for w, x in logs.items()}
    prob = {w: max(counts[w] - discount, 0) / n + discount * v / n * lattice[w] for w in vocabulary}
    rows = {r.doc_id: r for r in lm.score(spark.read.parquet(f"{SF}/documents.parquet"), lm.fold(lm.F.col("doc_id"), 10) != 0, {"doc_id": lm.F.col("doc_id")}, frequent_tokens=500).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        words, r = lm.tokens(d.text.encode()), rows[d.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
        assert r.score == pytest.approx(sum(logs[w] for w in words))
        assert r.adapted_score == pytest.approx(sum(math.log10(prob[w]) for w in words))


def test_lm_score_by_enumeration(spark):
    """Short texts: all segmentations of all words, listed one by one."""
    texts = ["the cat", "is  with\tende", "😀x is", "", None]
    pieces, ln10 = Pieces(RAW), math.log(10)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.score for r in lm.score(df, lm.F.lit(True), {"doc_id": lm.F.col("doc_id")}).collect()}
    for i, t in enumerate(texts):
        total = pieces.end_log / ln10
        for w in (t or "").split():
            total += math.log10(sum(math.exp(sum(pieces.log[k] for k in p)) for p in enumerate_paths(pieces, SPACE + w)))
        assert rows[i] == pytest.approx(total)


def test_lm_hot_token_of_held_out_rows(spark):
    """A token of no training row is resolved in place too if it is frequent."""
    df = spark.createDataFrame([(i, "seen here" if i % 2 else "unseen there") for i in range(200)], "doc_id long, text string")
    rows = lm.score(df, lm.F.col("doc_id") % 2 == 1, {"doc_id": lm.F.col("doc_id")}, frequent_tokens=3).collect()
    assert len(rows) == 200 and all(r.n_known == (3 if r.doc_id % 2 else 1) for r in rows)
    few = lm.score(df, lm.F.col("doc_id") % 2 == 1, {"doc_id": lm.F.col("doc_id")}, frequent_tokens=100).collect()
    flat = lambda rs: [x for r in sorted(rs) for x in r]
    assert flat(rows) == pytest.approx(flat(few))


@pytest.mark.parametrize("frequent", [0, 100])
def test_lm_takes_bytes_that_are_no_utf8(spark, frequent):
    df = spark.sql("select 1L as doc_id, cast(X'6162FF63206162' as string) as text union all select 2L, 'ab ab\u00e9' union all select 3L, cast(X'6162FE63' as string) union all select 4L, 'ab\ufffdc'")
    rows = {r.doc_id: r for r in lm.score(df, lm.F.col("doc_id") < 3, {"doc_id": lm.F.col("doc_id")}, frequent_tokens=frequent).collect()}
    assert {i: (r.n_tokens, r.n_known, r.train_tokens) for i, r in rows.items()} == {1: (3, 3, 6), 2: (3, 3, 6), 3: (2, 1, 6), 4: (2, 1, 6)}
    assert rows[3].score == pytest.approx(rows[4].score) and rows[3].base_score == pytest.approx(rows[4].base_score)


def test_lm_edges(spark, tmp_path):
    rows = lm.query(spark, edges.sf_dir(spark, tmp_path, documents=edges.documents(spark))).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[1].score == by[2].score
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert lm.query(spark, edges.sf_dir(spark, tmp_path / "none")).count() == 0


def test_lm_learned_score_by_brute_force(spark):
    texts = ["the cat sat the cat", "the dog sat, the dog barked", "a cat barked " * 40, "zyx zyx the cat", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = Counter(w for t in texts[:3] for w in lm.tokens(t.encode()))
    n, v, n1, n2 = sum(counts.values()), len(counts), *(sum(c == k for c in counts.values()) for k in (1, 2))
    discount = n1 / (n1 + 2 * n2)
    pieces = Pieces(RAW)
    ids = Counter(struct.unpack(f"<{len(p) // 4}I", p)[i] for p in pieces.paths([f" {w.decode()}" for w in counts if w]) for i in range(len(p) // 4))
    own, total = [math.exp(x) if x > -math.inf else 0.0 for x in pieces.log], sum(ids.values())
    weight = [(1 - lm.OWN) * sum(own) * ids[i] / total + lm.OWN * x for i, x in enumerate(own)]

    def prob(w: bytes) -> float:
        lattice = sum(math.prod(weight[k] for k in p) for p in enumerate_paths(pieces, SPACE + w.decode())) if w else math.exp(pieces.end_log)
        return max(counts[w] - discount, 0) / n + discount * v / n * lattice

    for frequent in (0, 100):
        rows = {r.doc_id: r.learned_score for r in lm.score(df, lm.F.col("doc_id") < 3, {"doc_id": lm.F.col("doc_id")}, frequent_tokens=frequent).collect()}
        for i, t in enumerate(texts):
            seen, log = Counter(), 0.0
            for at, w in enumerate(lm.tokens((t or "").encode())):
                log += math.log10((seen[w] + lm.URN * prob(w)) / (at + lm.URN))
                seen[w] += 1
            assert rows[i] == pytest.approx(log)


def test_lm_held_out_rows_score_near_base(spark):
    """The query's score learns: on rows that taught nothing it stays near the count model, which owes no word its letters."""
    rows = [r for r in lm.query(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert rows and all(math.isfinite(r.score) for r in rows)
    assert sum(r.score for r in rows) > 1.15 * sum(r.base_score for r in rows)
