"""Places of the same two texts and shift are compared once, however far each is followed."""

import random

from editlens.llm import substring_dedup
from editlens.llm.common import Scratch


def test_overlapping_places_are_compared_as_one(spark, monkeypatch):
    rng = random.Random(7)
    base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(1500)]
    near = [" ".join("x" * 7 if i % 100 == 10 + 7 * k else w for i, w in enumerate(base)) for k in range(3)]
    rounds, save = [], Scratch.save

    def spied(self, df):
        out = save(self, df)
        if out.columns == ["doc", "row", "start", "end", "ref_doc", "ref_row", "ref_start"]:
            rounds.append([tuple(r) for r in out.collect()])
        return out

    monkeypatch.setattr(Scratch, "save", spied)
    found = substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(near)), "doc_id long, text string"), 50).collect()
    assert {r.doc_id for r in found} == {1, 2}
    assert len(rounds) > 1
    for places in rounds:
        of = {}
        for doc, row, start, end, ref, ref_row, ref_start in places:
            of.setdefault((doc, row, ref, ref_row, ref_start - start), []).append((start, end))
        for spans in of.values():
            spans.sort()
            assert all(b[0] > a[1] for a, b in zip(spans, spans[1:]))


def test_texts_that_go_on_repeating_vote_for_few_places(spark, monkeypatch):
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n))
    times = [300] * 12 + [90, *[250] * 12]
    pairs = ["ab cd ", "the of ", "qu, ", "one another "]
    docs = [(i, f"{words(20)} {pairs[i % 4] * n}{words(20)}") for i, n in enumerate(times)]
    # and a text of few repeats before others of many
    docs += [(100 + i, f"{words(20)} {'up to ' * n}{words(20)}") for i, n in enumerate([40, *[310] * 6])]
    places, save = [], Scratch.save

    def spied(self, df):
        out = save(self, df)
        if out.columns == ["doc", "row", "start", "end", "ref_doc", "ref_row", "ref_start"]:
            places.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "save", spied)
    found = substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), 50).collect()
    assert sum(places) <= 12 * len(docs)
    # what repeats is found whole, as far as whole words go
    for doc, text in docs[4:]:
        if doc == 100:
            continue
        unit = "up to " if doc > 100 else pairs[doc % 4]
        a = text.index(unit * 40)
        covered = set()
        for r in found:
            if r.doc_id == doc:
                covered |= set(range(r.start, r.end))
        zone = set(range(a, a + len(unit) * text.count(unit) - len(unit)))
        assert len(zone - covered) <= 2 * len(unit), doc
