"""SentencePiece coding, divergence audit and hard negatives against the library and brute force, and on odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, decoded string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", "y") for r in rows], DOCS)


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def _texts():
    r = random.Random(3)
    signs = "abes thunk  ▁\n\t1239.,<>é世界日ｱ\U0001f600\x00̀"
    odd = [None, "", " ", "    ", "a▁b", "<s> </s> <0x41> <unk>", "a" * 5000, "ab " * 3000, "日本語テキスト" * 300, " " * 200 + "x", "x" + "\U0001f600" * 3]
    return odd + ["".join(r.choice(signs) for _ in range(r.randrange(90))) for _ in range(1500)]


def test_piece_bpe_equals_the_library(spark, model):
    from editlens.llm.piece_bpe import decode_ids, encode_texts, pieces, round_trip

    lib, texts = pieces(model).library, _texts()
    rows = [(i if i % 50 else None, t, "en", "s") for i, t in enumerate(texts)] + [(5, texts[20], "en", "s")] * 2
    want = sorted((i if i is not None else -1, len(ids := lib.encode(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()) for i, t, *_ in rows)
    got = round_trip(frame(spark, rows), model)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got.collect()) == want
    coded = encode_texts(frame(spark, rows), model)
    assert coded.columns == ["doc_id", "text", "lang", "source", "n_chars", "decoded", "ids", "n_tokens"]
    for r in decode_ids(coded, model).collect():
        assert r.ids == lib.encode(r.text or "") and r.n_tokens == len(r.ids) and r.decoded == lib.decode(r.ids)
    empty = frame(spark, rows).where("false")
    assert not round_trip(empty, model).collect() and not decode_ids(encode_texts(empty, model), model).collect()


def test_piece_agendas_agree(model):
    from editlens.llm.piece_bpe import pieces

    own = pieces(model)
    for t in _texts():
        t = (t or "").replace("▁", " ")
        assert own._merged(list(t)) == own._merged_by_heap(list(t))


def test_piece_decoding_of_any_ids(spark, model):
    """Bytes that are split, out of order or form no character; controls and the unknown id."""
    from editlens.llm.piece_bpe import decode_ids, pieces

    lib, r = pieces(model).library, random.Random(4)
    lists = [[r.randrange(300) if r.random() < 0.6 else r.randrange(32_000) for _ in range(r.randrange(12))] for _ in range(3000)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*lists, None])], "n long, ids array<int>")
    for x in decode_ids(rows, model).collect():
        assert x.decoded == lib.decode(x.ids or [])


def test_piece_cache_is_bounded(model, monkeypatch):
    from editlens.llm import piece_bpe
    from editlens.llm.common import utf8

    monkeypatch.setattr(piece_bpe, "CACHE", 20)
    own, met = piece_bpe.Pieces(model), set()
    for t in _texts()[:400]:
        ids, _ = own.encode(*utf8(pa.array([t], pa.string())))
        assert ids.tolist() == own.library.encode(t or "")
        met |= own.known.keys()
    assert len(own.known) + len(own.older) < len(met) / 2


def test_byte_decoding_of_split_characters(spark):
    """Ids that end or begin within a character."""
    P = pytest.importorskip("public_tokenizers")
    from editlens.llm.byte_bpe import decode_texts, read_ranks

    path = P.path("byte_bpe_multi_50k.tiktoken")
    token = {r: t for t, r in read_ranks(path).items()}
    r = random.Random(6)
    high = [i for i, t in token.items() if any(b >= 0x80 for b in t)]
    lists = [[r.choice(high) if r.random() < 0.7 else r.randrange(50_000) for _ in range(r.randrange(8))] for _ in range(2000)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*lists, None])], "n long, ids array<int>")
    for x in decode_texts(rows, path, P.PATTERN).collect():
        assert x.decoded == b"".join(token[i] for i in x.ids or []).decode("utf-8", "replace")


# ---------------------------------------------------------------- divergence of sources


def brute_divergence(rows, least, top):
    import re
    from collections import Counter, defaultdict

    groups, docs, counts = set(), defaultdict(Counter), defaultdict(Counter)
    for _, t, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, source in groups:
        kept = sorted(w for w, n in docs[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        share = lambda of, kept=kept: {w: 1 + 10**9 * (of[w] + 1) // (sum(of[x] for x in kept) + len(kept)) for w in kept}
        f = lambda p, q: (p - q) ** 2 // q
        p = share(counts[lang, source])
        pairs = [(sum(f(p[w], q[w]) for w in kept), s) for s in sources if s != source for q in [share(counts[lang, s])]]
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        terms = [(f(p[w], q[w]), w) for w in kept if counts[lang, source][w] and p[w] > q[w]]
        for part, items in (("pair", pairs), ("term", terms)):
            items = sorted(items, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, w, v, k) for k, (v, w) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def _divergent_rows():
    r = random.Random(8)
    words = ["Été", "river", "STONE", "straße", "Ünder", "a1b", "naïve", "x_y", "don't", "日本", "\U0001f600", "z"]
    rows = [(i, " ".join(r.choice(words[: r.randrange(2, 13)]) for _ in range(r.randrange(40))), r.choice(["en", "fr", None]), r.choice(["a", "b", "c", None])) for i in range(300)]
    rows += [(None, "only here here", "xx", "q"), (7, None, "xx", "r"), (7, "", "xx", "r"), (8, "12 !!", "yy", "s"), (9, "river " * 9000, "en", "long"), (1, None, None, None)]
    return rows + rows[:20]


@pytest.mark.parametrize("least, top, small", [(3, 200, False), (2, 3, True), (10_000, 5, False)])
def test_source_divergence_brute_force(spark, monkeypatch, least, top, small):
    from editlens.llm import divergence

    if small:  # many partial runs and blocks of pairs
        monkeypatch.setattr(divergence, "ROWS", 10)
        monkeypatch.setattr(divergence, "PAIRS", 3)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = _divergent_rows()
    try:
        got = divergence.source_divergence(frame(spark, rows).repartition(3), least, top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == brute_divergence(rows, least, top)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_source_divergence_of_nothing(spark):
    from editlens.llm.divergence import source_divergence

    assert source_divergence(frame(spark, [(1, "a", "b", "c")]).where("false")).collect() == []


def test_shares_and_sums_are_exact():
    from editlens.llm.divergence import shares

    r = random.Random(9)
    whole = [r.randrange(1, 10 ** r.randrange(1, 16)) for _ in range(2000)]
    count = [r.randrange(1, w + 1) for w in whole]
    got = shares(np.array(count), np.array(whole))
    assert got.tolist() == [1 + 10**9 * c // w for c, w in zip(count, whole)]


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    from editlens.llm import divergence

    plain = divergence.Words

    class Colliding(plain):
        def __init__(self, *a):
            super().__init__(*a)
            self.hash = self.hash % np.uint64(3)

    monkeypatch.setattr(divergence, "Words", Colliding)
    part = pa.record_batch([["en"] * 3, ["a b c d a", "b e", None], ["s", "t", "s"]], names=["lang", "text", "source"])
    got = {tuple(r.values()) for r in divergence.term_runs(part).to_pylist()}
    assert got == {("en", "a", "s", 1, 2), ("en", "b", "s", 1, 1), ("en", "c", "s", 1, 1), ("en", "d", "s", 1, 1), ("en", "b", "t", 1, 1), ("en", "e", "t", 1, 1)}


# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows, anchors, positives=5, negatives=5):
    ask = {}
    for i, label, v in anchors:
        ask[i] = min(ask.get(i, (label, v)), (label, v))
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, (label, q) in ask.items():
        scored = sorted((-dot(q, v), j, other) for j, other, v in rows if j != i)
        for p, j in [(-s, j) for s, j, other in scored if other == label][:positives]:
            hits = [(j2, -s) for s, j2, other in scored if other != label and 80 * p <= -100 * s <= 100 * p][:negatives]
            out |= {(i, j, k, j2, p, s) for k, (j2, s) in enumerate(hits, 1)}
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_brute_force(spark, monkeypatch, seed):
    """Small leaves, places and blocks; copies of a vector, ties, zero and negative scores, repeated ids."""
    from editlens.llm import hard_negatives as H
    from editlens.llm import shards, vector_search

    for name, value in (("LEAF", 4), ("SAMPLE", 40), ("CELL", 4), ("STEP", 2)):
        monkeypatch.setattr(H, name, value)
    monkeypatch.setattr(vector_search, "PLACE", 24)
    monkeypatch.setattr(shards, "QUERIES", 3)
    r = random.Random(seed)
    centre = [[r.randrange(-40, 41) for _ in range(6)] for _ in range(5)]
    rows = [(i, r.randrange(4), [x + r.randrange(-9, 10) for x in centre[i % 5]]) for i in range(300)]
    rows += [(1000 + i, r.randrange(4), list(centre[0])) for i in range(120)]  # copies of one vector
    rows += [(2000, 1, [0] * 6), (2001, 2, [0] * 6), (3, 2, [1] * 6), (3, 0, [2] * 6)]
    rows.append((3000, 9, centre[1]))  # no other row of its label
    schema = "vec_id long, label long, v array<long>"
    odd = [(None, 1, [1] * 6), (50_000, None, [90] * 6), (50_001, 1, [90] * 5)]
    asked = [x for x in rows if x[0] % 10 == 0 or x[0] == 3]
    got = H.hard_negatives(spark.createDataFrame(rows + odd, schema).repartition(5), spark.createDataFrame(asked + odd, schema))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, got.collect()))
    assert got == brute_negatives(rows, asked) and len({x[1] for x in got}) > 20


def test_hard_negatives_of_odd_rows(spark):
    from editlens.llm.hard_negatives import hard_negatives
    from editlens.llm.vector_search import quantized

    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.4]), (2, 2, [0.9, 0.3]), (3, 2, None), (4, 2, [float("nan"), 1.0]), (5, 2, [1.0, None]), (6, None, [1.0, 1.0]), (7, 2, [float("inf"), 1.0]), (8, 2, []), (9, 2, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    v = quantized(table, 256, "label")
    assert sorted(map(tuple, hard_negatives(v, v.where("vec_id = 0")).collect())) == [(0, 1, 1, 2, 256 * 256 + 128 * 102, 256 * 230 + 128 * 76)]
    assert hard_negatives(v.where("false"), v).collect() == [] and hard_negatives(v, v.where("false")).collect() == []
    huge = spark.createDataFrame([(0, 1, [3 * 10**9, 1]), (1, 1, [3 * 10**9, 0]), (2, 2, [28 * 10**8, 0]), (3, 3, [3 * 10**9, 5])], "vec_id long, label long, v array<long>")
    held = 1 << 62
    assert sorted(map(tuple, hard_negatives(huge, huge.where("vec_id = 0")).collect())) == [(0, 1, 1, 2, held, held), (0, 1, 2, 3, held, held)]


def test_leaves_lie_within_their_bounds():
    from editlens.llm.hard_negatives import Tree, apart
    from editlens.llm.vector_search import lift

    r = np.random.RandomState(3)
    v = r.randint(-300, 300, (3000, 16))
    most = float((v * v).sum(1).max()) + 1
    tree = Tree(np.arange(3000), np.zeros(3000, int), v, most)
    q = np.hstack([r.randint(-300, 300, (40, 16)).astype(float), np.zeros((40, 1))])
    least, greatest = tree.reach(q)
    d = apart(q, lift(tree.v, most))
    for leaf in range(len(tree.paths)):
        own = d[:, tree.edge[leaf] : tree.edge[leaf + 1]]
        assert (own >= least[:, leaf][:, None] - 1e-6).all() and (own <= greatest[:, leaf][:, None] + 1e-6).all()


def test_top_k_of_huge_components(spark):
    """The smallest integer has no absolute value in 64 bits; scores beyond 63 bits are held to 62."""
    from editlens.llm.vector_search import quantized, top_k

    v = quantized(spark.createDataFrame([(0, [1.0, 1.0]), (1, [-1e300, 1.0]), (2, [-5.0, 0.0])], "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in top_k(v, v, 10).orderBy("query_id", "rank").collect()]
    held = 1 << 62
    assert got == [(0, 1, 2, -5 * 1024 * 1024), (0, 2, 1, -held + 1), (1, 1, 2, held), (1, 2, 0, -held + 1), (2, 1, 1, held), (2, 2, 0, -5 * 1024 * 1024)]


# ---------------------------------------------------------------- repeated passages


def test_passages_of_short_and_long_words(spark):
    """At least 99 of 100 planted passages of 50 words are found, whatever the length of the words."""
    from editlens.llm.substring_dedup import repeated_passages

    r = random.Random(17)
    word = lambda a, b: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))
    kinds, rows, n = [(1, 1), (1, 2), (1, 3), (2, 3), (1, 6), (4, 7), (12, 12)], [], 300
    for k, (a, b) in enumerate(kinds):
        for i in range(n):
            passage = [word(a, b) for _ in range(50)]
            for copy in (0, 1):
                around = [[word(3, 9) for _ in range(r.randint(20, 60))] for _ in range(2)]
                rows.append((2 * (k * n + i) + copy, " ".join([*around[0], *passage, *around[1]])))
    got = {x.doc_id: x for x in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert all(x.doc_id % 2 and x.first_doc_id == x.doc_id - 1 and x.n_words >= 50 for x in got.values())
    share = [sum(2 * (k * n + i) + 1 in got for i in range(n)) / n for k in range(len(kinds))]
    print("recall by word length", dict(zip(kinds, share)))
    assert min(share) >= 0.99


def test_rows_of_one_id_are_cut_apart(spark, monkeypatch):
    """Each row is cut by its own passages, also with characters of several bytes; places of a busy document in parts."""
    from editlens.llm import substring_dedup as S

    monkeypatch.setattr(S, "PLACES", 3)
    words = lambda s, n, sign="w": [f"{sign}{random.Random(s * 1000 + i).randrange(10**6)}" for i in range(n)]
    p, q = words(1, 60), words(2, 60)
    rows = [(3, p + words(4, 10)), (5, ["x"] + p), (5, words(5, 150, "é")), (5, words(6, 150)), (5, ["x"] + p), (6, q), (6, q + words(7, 20)), (9, words(8, 30) + q + words(9, 30) + p), (None, p)]
    rows += [(100 + i, words(100 + i, 10) + p + words(200 + i, 10)) for i in range(40)]
    table = spark.createDataFrame([(i, " ".join(w), len(" ".join(w)), 1, 2, 3, "r") for i, w in rows], "doc_id long, text string, n_chars long, _of int, _cuts int, _own int, row string")
    got = S.without_repeats(table.repartition(5))
    assert got.columns == table.columns
    left = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in got.collect())
    at = lambda i: sorted(t for j, t in left if j == i)
    assert at(3) == [" ".join(p + words(4, 10))] and at(-1) == [" ".join(p)]
    assert at(5) == sorted(["x ", "x ", " ".join(words(5, 150, "é")), " ".join(words(6, 150))])
    assert at(6) == sorted([" ".join(q), " ".join(q + words(7, 20))])
    assert [t.split() for t in at(9)] == [words(8, 30) + words(9, 30)]
    for i in range(40):
        assert [t.split() for t in at(100 + i)] == [words(100 + i, 10) + words(200 + i, 10)]


def test_near_duplicates_keep_columns_of_any_name(spark):
    from editlens.llm.near_dedup import distinct_documents

    names = ["_text_hash", "_row_hash", "_hash_before", "_kept", "_own", "_OWN_"]
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, text), (1, text), (1, "another text of this id that is kept too"), (3, None), (None, text)]
    table = spark.createDataFrame([(*r, *range(6)) for r in rows], ", ".join(["doc_id long", "text string", *(f"{n} long" for n in names)]))
    got = distinct_documents(table)
    assert got.columns == table.columns
    assert sorted((r.doc_id or 0, r.text or "", tuple(r[2:])) for r in got.collect()) == sorted((i or 0, t or "", tuple(range(6))) for i, t in [rows[0], *rows[3:]])
