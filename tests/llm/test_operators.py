"""The corpus operators against brute force, round trips and held-out accuracy, and on odd rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, packed string, sig string"
WORDS = ["wolke", "river", "stone", "été", "mañana", "glass", "tower", "light", "north", "winter", "paper", "house", "train", "music", "ocean", "garden"]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "er", "ing", "."]) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "x", "x", "x") for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    base = [text(s, 80) for s in range(12)]
    out = [(i, base[i], "en") for i in range(12)]
    out += [(20, base[3], "en"), (21, base[3].upper(), "en"), (22, base[4] + " more words", "fr"), (23, " ".join(base[5].split()[:70]), None)]
    out += [(30, None, "en"), (31, "", "en"), (32, " \t\n", None), (33, "one", "de"), (34, "one", "de"), (35, "12 34 !!", "en"), (None, base[0], "en"), (None, None, None)]
    out += [(40, text(99, 30_000), "en"), (41, "a" * 50_000, "en"), (42, "ab " * 20_000, "en"), (43, "</s>\\[INST]    x \U0001f600 é", "en")]
    return out + [(5, base[5], "en"), (33, "one", "de")]


def sets(t, k):
    import re

    w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, k, percent):
    docs = [(i, sets(t, k)) for i, t, _ in rows if i is not None]
    up = {i: i for i, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in docs:
        for j, b in docs:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i, _ in docs}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_brute_force(spark, rows, k):
    from editlens.llm.near_dedup import distinct_documents, near_duplicates

    df = frame(spark, rows)
    got = near_duplicates(df, k, 80).collect()
    assert len(got) == len(rows)
    want = brute_components(rows, k, 80)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    sizes = {i: len(sets(t, k)) for i, t, _ in rows if i not in (None,)}
    assert all(sizes[r.doc_id] == r.n_shingles for r in got if r.doc_id is not None)
    kept = distinct_documents(df, k, 80)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({i for i, c in want.items() if i == c})


def test_near_duplicates_of_random_copies(spark):
    from editlens.llm.near_dedup import near_duplicates

    r = random.Random(4)
    base = [text(1000 + s, 120) for s in range(8)]
    rows = [(i, b, "en") for i, b in enumerate(base)]
    for i in range(8, 160):
        w = r.choice(base).split()
        for _ in range(r.randrange(0, 18)):
            w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en"))
    got = {x.doc_id: x.component_id for x in near_duplicates(frame(spark, rows), 2, 80).collect()}
    assert got == brute_components(rows, 2, 80)


@pytest.mark.parametrize("less, more", [(4, 5), (8, 10), (12, 15), (16, 20)])
def test_no_pair_at_the_threshold_is_lost(less, more):
    from editlens.llm.near_dedup import CHUNKS, ERRORS, K, REJECT, WIDTH, signatures, sketches

    r = np.random.RandomState(5)
    full = [r.randint(0, 1 << 63, more, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(100_000)]
    a, b = (signatures(x) for x in ([f[:less] for f in full], full))  # exactly 80 %
    shared = (a[:, :K] != b[:, :K]).reshape(-1, CHUNKS, WIDTH).sum(2).min(1) <= ERRORS
    far = np.bitwise_count(sketches(a).view(np.uint64) ^ sketches(b).view(np.uint64)).sum(1) > REJECT
    assert (~shared | far).sum() == 0


def test_near_duplicates_of_large_clusters(spark, monkeypatch):
    """Clusters over BLOCK: close pairs first, prefixes for the rest, among copies, near copies and pages of one template."""
    from editlens.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    monkeypatch.setattr(near_dedup, "STAR", 5)
    r = random.Random(14)
    rows = []
    for base in (text(2000, 120), text(2001, 25)):
        n = len(base.split())
        for _ in range(90):
            w = base.split()
            for _ in range(r.randrange(0, n // 5)):
                w[r.randrange(n)] = f"w{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w), "en"))
    template = text(2002, 70)
    for i in range(60):
        rows.append((len(rows), template + " " + text(3000 + i // 2, r.randrange(5, 40)), "en"))
    rows += [(5, rows[100][1], "en"), (len(rows), rows[3][1], "en")]
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(frame(spark, rows), 2, 80).collect()}
    assert got == brute_components(rows, 2, 80)
    assert near_dedup.near_duplicates(frame(spark, []), 2, 80).count() == 0


def test_components_of_a_long_chain(spark, monkeypatch):
    from editlens.llm import components
    from editlens.llm.common import Scratch

    monkeypatch.setattr(components, "EDGES", 40)
    scratch = Scratch(spark)
    links = scratch.save(spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).repartition(7).union(spark.createDataFrame([(300, 301)], "a long, b long")))
    got = {r.id: r.component for r in components.connected_components(links, scratch).collect()}
    assert got == {**{i: 0 for i in range(200)}, 300: 300, 301: 300}


def test_bpe_equals_the_rank_rule_and_round_trips(spark, rows):
    import public_tokenizers as P
    import tiktoken

    from editlens.llm.byte_bpe import decode_texts, encode_texts, round_trip

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [(100 + i, t, "en") for i, t in enumerate(["a  b", "x　 y  z", "  lead", "trail  ", "it's we'll 12 3!?", "\n\n \n a", "日本語 テキスト", "\U0001f600\U0001f600 é", "aaaaaa aaaaaaa", "a   b \u0085 c"])]
    df = frame(spark, [*rows, *odd])
    got = round_trip(df, path, P.PATTERN).collect()
    want = sorted((i if i is not None else -1, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in [*rows, *odd] for x in [exact.encode_ordinary(t or "")])
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = decode_texts(encode_texts(df, path, P.PATTERN), path, P.PATTERN)
    assert back.where("decoded != coalesce(text, '')").count() == 0


def test_chat_round_trip(spark):
    from editlens.llm.chat_format import CONTROL, digests, format_chats, read_back

    said = ["", None, "\\", "\\\\n<|im_end|>\n", "</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "<", "s>", "é\U0001f600", *CONTROL, "x" * 100_000]
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "to\nol\\"]), r.choice(said)) for c in [*range(40), None] for t in range(r.randrange(1, 7))]
    rows += [(7, 0, "assistant", "again"), (7, 0, "assistant", "again")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = format_chats(df)
    convs = {}
    for x in rows:
        convs.setdefault(x[0], []).append(x)
    alone = [x for x in convs.pop(None)]  # each a conversation of its own
    none = [row for row in out.collect() if row.conv_id is None]
    assert sorted(read_back(row.formatted) for row in none) == sorted([(x[2] or "", x[3] or "")] for x in alone)
    assert format_chats(df.where("false")).count() == 0
    for row in out.where("conv_id is not null").collect():
        want = [(x[2] or "", x[3] or "") for x in sorted(convs[row.conv_id], key=lambda x: (x[1], x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))]
        assert read_back(row.formatted) == want and row.n_turns == len(want)
        for s in CONTROL[2:]:
            assert s not in row.formatted
    for d in digests(out.where("conv_id is not null")).collect():
        turns = [(x[2] or "", x[3] or "") for x in sorted(convs[d.conv_id], key=lambda x: (x[1], x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (d.loss_chars, d.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def labelled(spark, n=1500):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        w = text(i, 60).split()
        bad = r.random() < 0.2
        if bad:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["vile", "rotten", "filthy"])
        docs.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_held_out(spark, rows):
    from editlens.llm.toxicity import toxicity, without_toxic

    docs, labels = labelled(spark)
    odd = [(i + 10_000 if i is not None else None, t, g) for i, t, g in rows]
    df = frame(spark, docs + odd)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity(df, lab).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    kept = without_toxic(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in got)
    none = toxicity(df, lab.where("false")).collect()
    assert {r.score for r in none} == {0.0}


def test_toxicity_brute_force(spark):
    """FTRL-proximal one coordinate and one document after the other, over dictionaries of words, pairs and skip-pairs."""
    import math

    from editlens.llm import toxicity as T

    docs, labels = labelled(spark, 220)
    docs += [(1000, None, "en"), (1001, "", "en"), (3, docs[3][1], "en"), (1002, text(4, 20_000), "en")]

    def features(t):
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        return {(x,) for x in w} | {("next", a, b) for a, b in zip(w, w[1:])} | {("over", a, b) for a, b in zip(w, w[2:])}

    for _, t, _ in docs[:50] + docs[-4:]:
        ids, of = T._features(pa.array([t], pa.string()))
        assert len(set(ids.tolist())) <= len(features(t)) <= 1.02 * len(set(ids.tolist())) + 1  # a bucket may hold two

    place = {r.doc_id: r.x for r in spark.createDataFrame([(i,) for i, *_ in labels], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("x")).collect()}
    learned = sorted((place[i], i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5)
    texts = {i: t for i, t, _ in docs}
    z, s = {}, {}

    def weight(k):
        v, cut = z.get(k, 0.0), 0.0 if k == "bias" else T.L1
        return 0.0 if abs(v) <= cut else -(v - math.copysign(cut, v)) / ((T.BETA + math.sqrt(s.get(k, 0.0))) / T.ALPHA + (0.0 if k == "bias" else T.L2))

    bucket = {t: sorted(set(T._features(pa.array([t], pa.string()))[0].tolist())) + ["bias"] for t in texts.values()}
    for epoch in range(T.EPOCHS):
        for n in np.random.RandomState(epoch).permutation(len(learned)):
            _, i, y = learned[n]
            own = {k: weight(k) for k in bucket[texts[i]]}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(own.values()))))) - y
            for k, w in own.items():
                z[k] = z.get(k, 0.0) + g - (math.sqrt(s.get(k, 0.0) + g * g) - math.sqrt(s.get(k, 0.0))) / T.ALPHA * w
                s[k] = s.get(k, 0.0) + g * g
    for r in T.toxicity(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect():
        assert abs(r.score - 1 / (1 + math.exp(-sum(weight(k) for k in bucket[texts[r.doc_id]])))) < 1e-9
    assert T.toxicity(frame(spark, []), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_language_id(spark, rows):
    from editlens.llm.language_id import language_id

    said = {"en": "the of and with that this over", "fr": "le des une avec pour été dans", "de": "der die und nicht auf ein über"}
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(said[g].split()) for _ in range(12)), g) for i in range(400) for g in [r.choice(list(said))]]
    got = {x.doc_id: x for x in language_id(frame(spark, docs + [(None, None, None), (1001, None, "en"), (1002, "12 !", "en"), (1003, "", None), (1004, "x" * 30_000, None)])).collect()}
    held = [(i, g) for i, _, g in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held) and np.mean([got[i].lang_pred == g for i, g in held]) > 0.97
    assert {got[i].lang_pred for i in (1001, 1002, 1003)} == {"und"} and got[1004].lang_pred in said
    assert language_id(frame(spark, docs[:3]).withColumn("lang", F.lit(None).cast("string"))).where("lang_pred != 'und'").count() == 0
    assert language_id(frame(spark, [])).count() == 0
    tie = [(i, t, g) for i, (t, g) in enumerate([("abc", "b"), ("abc", "a")] * 4)]
    assert {x.lang_pred for x in language_id(frame(spark, tie)).collect() if sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _, g in tie if g == "a") == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _, g in tie if g == "b")} <= {"a"}


def test_language_id_brute_force_in_blocks_of_languages(spark, monkeypatch):
    """Against naive Bayes over dictionaries of n-grams (by bucket), for more languages than one block has."""
    import math
    import re

    from editlens.llm import language_id as L

    monkeypatch.setattr(L, "LANGUAGES", 3)
    r = random.Random(15)
    said = {f"l{k}": [text(100 + 7 * k + j, 1)[:6] for j in range(8)] for k in range(8)}
    docs = [(i, " ".join(r.choice(said[g]) for _ in range(r.randrange(1, 9))), g) for i in range(160) for g in [r.choice(list(said))]]
    learned = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 != 2]

    def grams(t):
        s = re.sub("[^a-zéñ]+", " ", t.lower())
        s = s.lstrip()
        found = [s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1) if s[i : i + k] != " "]
        buckets = L.ngrams(pa.array([t]))[0].tolist()
        assert len(buckets) == len(found) and all(known.setdefault(x, b) == b for x, b in zip(found, buckets))
        return buckets

    known, counts, texts = {}, {g: {} for g in said}, {g: 0 for g in said}
    for _, t, g in learned:
        texts[g] += 1
        for x in grams(t):
            counts[g][x] = counts[g].get(x, 0) + 1

    def scores(t):
        return {g: math.log(texts[g] / len(learned)) + sum(math.log((counts[g].get(x, 0) + L.ALPHA) / (sum(counts[g].values()) + L.ALPHA * (1 << L.BITS))) for x in grams(t)) for g in said}

    got = {x.doc_id: x for x in L.language_id(frame(spark, docs)).collect()}
    for i, t, _ in docs:
        s = scores(t)
        best = min(s, key=lambda g: (-s[g], g))
        share = 1 / sum(math.exp(v - s[best]) for v in s.values())
        assert got[i].lang_pred == best and abs(got[i].score - share) < 1e-9


def test_top_k_brute_force(spark):
    from editlens.llm.vector_search import quantized, top_k

    rng = np.random.RandomState(0)
    v = rng.standard_normal((900, 8)).round(1)
    v[100:200] = v[0]
    rows = [(i, [float(x) for x in r], "x") for i, r in enumerate(v)]
    rows += [(2000, None, "x"), (2100, [None] * 8, "x"), (2200, [float("nan")] + [0.0] * 7, "x"), (2300, [float("inf")] * 8, "x"), (None, [1.0] * 8, "x"), (300, [float(x) for x in v[300]], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    data = quantized(df)
    got = {}
    for r in top_k(data, data.where("vec_id % 100 = 0").dropDuplicates(["vec_id"]), 10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ids = np.array([*range(900), 300])
    q = np.floor(1024 * np.array([np.float32(x) for x in np.vstack([v, v[300]])], np.float64)).astype(np.int64).reshape(len(ids), 8)
    assert sorted(got) == list(range(0, 900, 100))
    for query in got:
        s = q @ q[query]
        best = sorted((-int(s[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != query)[:10]
        assert [got[query][n] for n in range(1, 11)] == [(i, -x) for x, i in best]
    assert top_k(data.where("false"), data.where("false")).count() == 0
    repeated = top_k(data, data.where("vec_id in (300, 500)"), 10).groupBy("query_id").count().collect()
    assert sorted((r.query_id, r["count"]) for r in repeated) == [(300, 10), (500, 10)]


def test_top_k_of_odd_vectors(spark):
    from editlens.llm.vector_search import quantized, top_k

    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(100, [1.0, 2.0, 3.0]), (200, []), (300, [5.0]), (400, [1e15, 1e15]), (401, [1e15, -1e15])]
    data = quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in top_k(data, data.where("vec_id in (0, 3, 100, 300, 400)"), 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [0, 3, 400]  # others have another length
    assert [x[1] for x in sorted(got[3])] == [400, 401, 29] and sorted(got[400])[0][1] == 29 or sorted(got[400])[0][2] > 1 << 60


def test_masked_lm(spark, rows):
    from editlens.llm.masked_lm import pseudo_likelihood

    r = random.Random(9)
    order = ["alpha beta gamma delta", "one two three four"]
    docs = [(i, " ".join(r.choice(order) for _ in range(40)), "en") for i in range(200)]
    mixed = "gamma alpha four beta two delta one three".split()
    odd = [(1000, " ".join(r.choice(mixed) for _ in range(160)), "en"), (1001, None, "en"), (1002, "", "en"), (None, "alpha beta", "en")]
    got = {x.doc_id: x for x in pseudo_likelihood(frame(spark, docs + odd)).collect()}
    assert len(got) == len(docs) + len(odd) and (got[1001].n_words, got[1001].log_prob, got[1001].mean_log_prob) == (0, 0.0, None)
    assert got[1000].mean_log_prob < np.mean([got[i].mean_log_prob for i in range(200)]) - 0.2
    assert pseudo_likelihood(frame(spark, docs).where("false")).count() == 0
    odd = [(1, None, "en"), (2, " 1 ", "en"), (3, " . ", None), (4, text(1, 60_000), "en"), (5, "same words here", "en"), (5, "same words here", "en"), (None, "same words here", "en")]
    got = [tuple(x) for x in pseudo_likelihood(frame(spark, odd)).collect()]
    assert len(got) == len(odd) and len({round(x[2], 4) for x in got if x[1] == 3}) == 1 and {x[1] for x in got} == {0, 1, 3, 60_000}


def test_masked_lm_tells_words_of_equal_frequency_apart(spark):
    """Words that occur alike often, in fixed pairs: the word itself is predicted from its neighbours, not its frequency."""
    from editlens.llm.masked_lm import pseudo_likelihood

    r = random.Random(12)
    pairs = [(f"left{k}", f"right{k}") for k in range(12)]
    docs = [(i, " ".join(f"{a} {b}" for a, b in (r.choice(pairs) for _ in range(60))), "en") for i in range(500)]
    a, b = "left3 right3 left5 right5 left7 right7", "left3 right5 left5 right7 left7 right3"
    got = {x.doc_id: x.mean_log_prob for x in pseudo_likelihood(frame(spark, docs + [(900, a, "en"), (901, b, "en")])).collect()}
    assert got[900] > got[901] + 0.5


def test_masked_lm_probabilities_and_model(spark, monkeypatch):
    """All words' probabilities sum up to one at every position; rare words have exact shares; the score is that of the
    formula written out; the model doesn't depend on how many tasks there are."""
    from editlens.llm import masked_lm as M
    from editlens.llm.common import Scratch

    r = np.random.RandomState(2)
    n, counts = 40, np.sort(r.randint(5, 500, 40))[::-1]
    names = [f"w{i}" for i in range(n)]
    hashes = M.words_of(pa.array([" ".join(names)])).hash
    monkeypatch.setattr(M, "TOP", 9)
    lexicon = M.Lexicon(hashes, counts, 77)
    nodes, turns, start = M.huffman(np.append(counts, 77).astype(float))
    for x in range(n + 1):  # the top and the rest are all steps of the tree
        own = dict(zip(lexicon.nodes[lexicon.start[x] : lexicon.start[x + 1]], lexicon.turns[lexicon.start[x] : lexicon.start[x + 1]]))
        own |= {k: v for k, v in zip(lexicon.top, lexicon.top_turns[x]) if v}
        assert own == dict(zip(nodes[start[x] : start[x + 1]], turns[start[x] : start[x + 1]]))
    net = M.Network(lexicon)
    net.parts[2] += r.standard_normal(net.parts[2].shape).astype(np.float32)
    context = r.randint(0, n, (len(M.OFFSETS), 7))
    every = np.stack([np.exp(net.log_prob(context, np.full(7, leaf))) for leaf in range(n + 1)])
    assert np.abs(every.sum(0) - 1).max() < 1e-4
    before = net.log_prob(context, np.arange(7)).sum()
    for _ in range(20):
        net.step(context, np.arange(7))
    assert net.log_prob(context, np.arange(7)).sum() > before + 1  # it learns what it is shown

    docs = [(i, text(i, 50), "en") for i in range(300)] + [(900, "once only", "en")]
    df = frame(spark, docs)
    runs = [{x.doc_id: x.log_prob for x in M.pseudo_likelihood(df.repartition(k)).collect()} for k in (1, 7)]
    assert all(abs(runs[0][i] - runs[1][i]) < 1e-2 for i in runs[0])
    plain = df.select("doc_id", "text")
    counted = Scratch(spark).save(plain.select("text").mapInArrow(M.tidy(M._count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    words = M.lexicon(counted)
    embed, bias, vectors, base = M.Network(words, M.train(plain, words, 20_000)).parts
    said = docs[4][1].split()
    number, leaf = words.look_up(M.words_of(pa.array([" ".join(said)])).hash)
    total, flat = 0.0, M.words_of(pa.array([docs[4][1]]))
    for i in range(len(number)):
        near = [number[i + o] if 0 <= i + o < len(number) else M.EDGE for o in M.OFFSETS]
        hidden = np.tanh(sum(embed[k][x] for k, x in enumerate(near)) + bias)
        steps = [(words.nodes[at], words.turns[at]) for at in range(words.start[leaf[i]], words.start[leaf[i] + 1])]
        steps += [(node, turn) for node, turn in zip(words.top, words.top_turns[leaf[i]]) if turn]
        for node, turn in steps:
            total -= np.log1p(np.exp(-turn * (hidden @ vectors[node] + base[node])))
    assert len(flat.hash) == len(number) and abs(total - runs[0][4]) < 0.05


def test_masked_lm_rare_words_have_their_own_counts(spark, monkeypatch):
    from editlens.llm import masked_lm as M

    docs = [(i, "often " * 50 + "also " * 40, "en") for i in range(20)] + [(100, "twice", "en"), (101, "twice", "en"), (102, "single", "en")]
    monkeypatch.setattr(M, "VOCABULARY", 2)
    df = frame(spark, docs)
    got = {x.doc_id: x.log_prob for x in M.pseudo_likelihood(df).collect()}
    assert abs(got[100] - got[102] - np.log(2)) < 1e-6 and got[100] == got[101]


def test_repeated_passages(spark):
    from editlens.llm.substring_dedup import repeated_passages, without_repeats

    r = random.Random(2)
    own = lambda s, n: " ".join(f"{random.Random(s * 10_000 + i).choice(WORDS)}{random.Random(s * 777 + i).randrange(10**5)}" for i in range(n))
    passage, short = own(900, 60), own(901, 20)
    rows = []
    for i in range(40):
        parts = [own(i, 50), own(i + 100, 30)]
        if i % 3 == 0:
            parts.insert(1, passage)
        if i % 4 == 0:
            parts.insert(1, short)
        rows.append((i, " ".join(parts), "en"))
    rows += [(100, rows[1][1], "en"), (101, None, "en"), (102, "", "en"), (None, passage, "en"), (103, own(103, 5) + " " + "é " * 400, "en"), (104, "é " * 400 + own(104, 5), "en")]
    r.shuffle(rows)
    df = frame(spark, rows)
    got = repeated_passages(df).collect()
    texts = {i: t for i, t, _ in rows}
    assert {x.doc_id for x in got} >= {*range(3, 40, 3), 100} and not {x.doc_id for x in got} & {i for i in range(40) if i % 3}
    for x in got:
        said = texts[x.doc_id].encode()[x.start : x.end].decode()
        assert len(said.split()) == x.n_words >= 50
        if x.doc_id < 40:
            assert passage in said and said in f"{short} {passage}"
    clean = {x.doc_id: x.text for x in without_repeats(df).collect()}
    assert 100 not in clean and clean[101] is None and clean[1] == texts[1]
    assert passage in clean[0] and all(passage not in clean[i] for i in range(3, 40, 3))
    assert without_repeats(df).columns == df.columns and repeated_passages(df.where("false")).count() == 0


def repeat_rows():
    """Passages of 50 to 55 words in pairs of documents, of which outer and inner words stand in smaller documents too."""
    own = lambda s, n: [f"{random.Random(s * 10_000 + i).choice(WORDS)}{random.Random(s * 777 + i).randrange(10**5)}" for i in range(n)]
    rows = []
    for p in range(60):
        passage, at = own(5000 + p, 50 + p % 6), p % 40
        for k, part in enumerate((passage[:9], passage[-9:], passage[at : at + 9])):  # chunks of these vote for others
            rows.append((10 * p + k, " ".join(own(6000 + 10 * p + k, 30) + part + own(7000 + 10 * p + k, 30))))
        for k in (5, 6):
            rows.append((10 * p + k, " ".join(own(8000 + 10 * p + k, 40) + passage + own(9000 + 10 * p + k, 40))))
    return rows


def test_repeated_passages_whose_ends_stand_elsewhere(spark):
    from editlens.llm.substring_dedup import repeated_passages

    rows = repeat_rows()
    got = {(x.doc_id, x.n_words, x.first_doc_id) for x in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == {(10 * p + 6, 50 + p % 6, 10 * p + 5) for p in range(60)}


def test_a_long_passage_whose_chunks_vote_elsewhere_is_followed(spark):
    from editlens.llm.substring_dedup import repeated_passages

    own = lambda s, n: [f"{random.Random(s * 10_000 + i).choice(WORDS)}{random.Random(s * 777 + i).randrange(10**5)}" for i in range(n)]
    passage = own(70, 900)
    rows = [(i, " ".join(own(7000 + i, 20) + passage[i : i + 24] + own(8000 + i, 20))) for i in range(0, 900, 12) if not 430 < i < 470]
    rows += [(2000, " ".join(own(71, 60) + passage + own(72, 60))), (2001, " ".join(own(73, 500) + passage + own(74, 5)))]
    got = {(x.doc_id, x.n_words, x.first_doc_id) for x in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == {(2001, 900, 2000)}


def common_runs(a, b, least):
    """Word places of b that lie in a run of ``least`` words that a has too."""
    runs = {tuple(a[i : i + least]) for i in range(len(a) - least + 1)}
    return {j + k for j in range(len(b) - least + 1) if tuple(b[j : j + least]) in runs for k in range(least)}


def test_repeated_passages_brute_force(spark):
    """Every reported passage stands in its first document (precision 1), and all words that stand in one smaller document
    in 50 words or more are in a passage but for a hundredth of them (recall)."""
    from editlens.llm.substring_dedup import repeated_passages

    r = random.Random(31)
    pool = [text(9000 + i, r.randrange(30, 140)).split() for i in range(25)]
    docs = []
    for i in range(120):
        w = text(9500 + i, r.randrange(0, 60)).split()
        for _ in range(r.randrange(0, 3)):
            p = list(r.choice(pool))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = f"changed{i}"
            a = r.randrange(0, len(p) // 3)
            w += p[a:] + text(9800 + i, r.randrange(1, 40)).split()
        docs.append((i, w))
    docs += [(300, ["solo"] * 4000 + ["end"]), (301, text(77, 9).split() + ["solo"] * 4000), (302, text(5, 3000).split()), (303, text(5, 3000).split()[700:])]
    got = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(6)).collect()
    texts = {i: " ".join(w) for i, w in docs}
    found = {}
    for x in got:
        said = texts[x.doc_id].encode()[x.start : x.end].decode()
        assert f" {said} " in f" {texts[x.first_doc_id]} " and x.first_doc_id < x.doc_id and len(said.split()) == x.n_words >= 50
        first = len(texts[x.doc_id].encode()[: x.start].decode().split())
        found.setdefault(x.doc_id, set()).update(range(first, first + x.n_words))
    due = {i: set().union(*(common_runs(a, b, 50) for j, a in docs if j < i), set()) for i, b in docs}
    assert all(found.get(i, set()) <= due[i] for i, _ in docs)
    assert sum(len(found.get(i, set())) for i in due) >= 0.99 * sum(map(len, due.values()))


def test_no_passage_of_pieces_of_several_documents(spark):
    from editlens.llm.substring_dedup import repeated_passages

    own = lambda s, n: [f"{random.Random(s * 10_000 + i).choice(WORDS)}{random.Random(s * 777 + i).randrange(10**5)}" for i in range(n)]
    rows = []
    for i in range(20):
        whole = own(3000 + i, 70)
        for k, part in enumerate((whole[:42], whole[28:], whole)):  # every chunk of the last stands in one of the others
            rows.append((10 * i + k, " ".join(own(3100 + 10 * i + k, 30) + part + own(4100 + 10 * i + k, 30))))
    assert not repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def test_decontamination(spark):
    from editlens.llm.decontaminate import overlaps, without_contaminated

    items = [(i, text(5000 + i, 30), "x") for i in range(20)] + [(20, None, "x"), (21, "", "x"), (22, "solo", "x"), (23, text(5999, 7), "x")]
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    r = random.Random(8)

    def altered(t, share):
        w = t.split()
        for i in range(0, len(w), share):
            w[i] = f"zz{r.randrange(10**6)}"
        return " ".join(w)

    own = lambda s: " ".join(f"{random.Random(s * 99 + i).choice(WORDS)}{random.Random(s * 7 + i).randrange(10**5)}" for i in range(60))
    docs = [(i, own(i), "en") for i in range(30)]
    docs += [(100, own(100) + " " + items[3][1], "en"), (101, altered(items[4][1], 8) + " " + own(101), "en"), (102, " ".join(items[5][1].split()[:16]), "en"), (103, " ".join(items[6][1].split()[:9]), "en"), (104, own(1) + " Solo. " + own(2), "en"), (105, items[23][1].upper(), "en"), (106, None, "en"), (107, "", "en")]
    df = frame(spark, docs)
    got = {(x.doc_id, x.item_id) for x in overlaps(df, bench).collect()}
    assert got == {(100, 3), (101, 4), (102, 5), (105, 23)}  # an item of one word overlaps nothing
    assert {(x.doc_id, x.item_id) for x in overlaps(df, bench, least_item=1).collect()} == got | {(104, 22)}
    assert sorted(x.doc_id for x in without_contaminated(df, bench).collect()) == [*range(30), 103, 104, 106, 107]
    assert overlaps(df, bench.where("false")).count() == overlaps(df.where("false"), bench).count() == without_contaminated(df.where("false"), bench).count() == 0
    odd = [(None, items[3][1], "en"), (200, text(1, 30_000) + " " + items[7][1] + " " + text(2, 30_000), "en"), (201, items[8][1], "en"), (201, items[8][1], "en")]
    assert sorted((x.doc_id or -1, x.item_id) for x in overlaps(frame(spark, odd), bench).collect()) == [(-1, 3), (200, 7), (201, 8), (201, 8)]


def test_decontamination_in_blocks(spark, monkeypatch):
    from editlens.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    items = [(i, text(7000 + i, 30)) for i in range(12)]
    docs = [(i, t, "en") for i, t in items]
    got = {(x.doc_id, x.item_id) for x in decontaminate.overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got >= {(i, i) for i in range(12)}


def test_decontamination_finds_every_run_of_four_fifths():
    import itertools

    from editlens.llm.decontaminate import MIN_WORDS, Index

    def search(item, doc):
        index = Index(np.array([7]), pa.array([" ".join(item)]), 1)
        return index.search(pa.array([" ".join(["before"] * 3 + doc + ["after"] * 3)]))

    for n in range(1, 18):
        item = [f"w{i}" for i in range(n)]
        least = min(n, MIN_WORDS)
        for changed in range(0, 5):
            for places in itertools.combinations(range(n), changed):
                doc = ["other" if i in places else x for i, x in enumerate(item)]
                runs = [(b - a, sum(x != "other" for x in doc[a:b])) for a in range(n) for b in range(a + least, n + 1)]
                whole = any(5 * equal >= 4 * covered for covered, equal in runs)
                got = search(item, doc)
                assert bool(got) == whole, (n, places)
                for _, _, equal, covered, size, start, end in got:
                    assert (size, end - start) == (n, covered) and covered >= least and 5 * equal >= 4 * covered
                    assert equal == sum(x == y for x, y in zip(doc[start - 3 : end - 3], item[start - 3 :]))
    long = [f"w{i}" for i in range(25)]
    assert search(long, ["other" if i in (4, 9, 14, 19) else x for i, x in enumerate(long)])


def test_license_scan(spark):
    from editlens.llm.licenses import WORDINGS, license_scan

    mit, gpl = WORDINGS[0][1].replace("{", "").replace("}", ""), "This work is licensed under the GNU General Public License, version 3."
    short, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    docs = [(1, "Start here. " + mit + " The end.", "en"), (2, mit.replace("free of charge", "without any fee").replace("merge, ", ""), "en"), (3, gpl.upper(), "en"), (4, "nothing to see", "en"), (5, None, "en"), (6, "", "en"), (7, "\n".join([short, "x y z", apache]), "en"), (8, " ".join(mit.split()[:20]), "en"), (None, short, "en")]
    docs += [(20, "Licensed under CC BY 4.0.", "en"), (21, "Licensed under CC BY-SA 4.0.", "en"), (22, "GNU General Public License, version 2.", "en"), (23, "Released under the BSD License.", "en"), (24, "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "en")]
    docs += [(30, f"{short} {short}", "en"), (31, text(3, 20_000) + " " + " and ".join([short] * 4000), "en"), (30, f"{short} {short}", "en"), (32, "Licensed under CC BY-ND-SA 4.0.", "en")]
    got = license_scan(frame(spark, docs)).collect()
    count = {}
    for r in got:
        count[r.doc_id, r.license] = count.get((r.doc_id, r.license), 0) + 1
    one = [(1, "MIT"), (2, "MIT"), (3, "GPL-3.0"), (7, "MIT"), (7, "Apache-2.0"), (None, "MIT"), (20, "CC-BY-4.0"), (21, "CC-BY-SA-4.0"), (22, "GPL-2.0"), (23, "BSD"), (24, "CC-BY-ND-4.0")]
    assert count == {**{x: 1 for x in one}, (30, "MIT"): 4, (31, "MIT"): 4000}
    assert all(0.8 <= r.coverage <= 1 for r in got)
    assert next(r for r in got if r.doc_id == 1).span.startswith("permission is hereby")
    assert license_scan(frame(spark, [])).count() == 0


def test_license_templates_name_themselves():
    from editlens.llm.licenses import TEMPLATES, Templates

    index = Templates()
    for name, wording in TEMPLATES:
        found = [(x[1], x[2]) for x in index.search(pa.array(["Some words before. " + wording.replace("{", "").replace("}", "") + " And some behind."]), 0.8)]
        assert [x[0] for x in found] == [name], wording


def test_license_alignment_brute_force():
    from editlens.llm.licenses import BAND, align

    r = np.random.RandomState(11)
    for _ in range(300):
        template = r.randint(0, 30, r.randint(4, 40))
        body = []
        for w in template:  # a few words less, more or others, as few as the band has
            x = r.rand()
            body += [] if x < 0.08 else [99, w] if x < 0.16 else [98] if x < 0.24 else [w]
        words = np.concatenate([r.randint(0, 30, r.randint(0, 20)), body, r.randint(0, 30, r.randint(0, 20))]).astype(np.int64)
        places = [(i, j) for i in range(len(template)) for j in range(len(words)) if template[i] == words[j]]
        if not places:
            continue
        i, j = places[r.randint(len(places))]

        def best(a, b):  # all of the matrix that the band allows, cell by cell
            s = np.full((len(a) + 1, len(b) + 1), -(10**6))
            s[0, 0] = 0
            for x in range(len(a) + 1):
                for y in range(len(b) + 1):
                    if abs(x - y) <= BAND and (x or y):
                        s[x, y] = max(s[x - 1, y - 1] + (2 if a[x - 1] == b[y - 1] else -2) if x and y else -(10**6), s[x - 1, y] - 1 if x else -(10**6), s[x, y - 1] - 1 if y else -(10**6))
            return s.max()

        score, pairs = align(template, words, i, j)
        assert score == best(template[i:], words[j:]) + best(template[:i][::-1], words[:j][::-1])
        assert all(template[x] == words[y] for x, y in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


def test_pipeline_stages(spark, tmp_path, rows):
    import corpus_pipeline

    docs, labels = labelled(spark, 600)
    passage = " ".join(f"p{i}q" for i in range(60))
    docs += [(2000, text(77, 90), "en"), (2001, text(77, 90), "en"), (2002, passage + " " + text(90078, 50), "en"), (2003, text(90079, 50) + " " + passage, "en"), (2004, text(5, 40) + " " + "bench item words are here to be found by anyone who looks for them now", "en"), (2005, None, None), (2006, "", "en")]
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in docs], plain).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "bench item words are here to be found by anyone who looks for them now")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # the same by the classifier's own predictions and brute force for what follows
    from editlens.llm.toxicity import toxicity

    clean = {r.doc_id for r in toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).where("predicted = 0").collect()}
    left = [d for d in docs if d[0] in clean]
    first = brute_components(left, 5, 80)
    left = [d for d in left if first[d[0]] == d[0]]
    item = "bench item words are here to be found by anyone who looks for them now".split()
    left = [d for d in left if not common_runs(item, (d[1] or "").split(), 13)]
    assert set(got) == {d[0] for d in left}
    assert 2000 in got and 2001 not in got and 2004 not in got and {2002, 2003, 2005, 2006} <= set(got)
    assert all(r.restored for r in got.values())
    assert got[2003].n_tokens < got[2002].n_tokens
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & set(got)) < 0.05 * len(toxic) and len(set(got) - toxic) > 0.95 * (600 - len(toxic))
    at = str(tmp_path / "none")
    for name, columns in (("documents", plain), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{at}/{name}.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
