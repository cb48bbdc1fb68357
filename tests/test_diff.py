"""Version diff: table-driven cases, old and new version to operations in order of emission."""

import datetime as dt

import pytest

from editlens.operators.diff import list_edits, member_edits, version_diff, way_edits
from editlens.plans.schema import ELEMENT_VERSIONS

T0 = dt.datetime(2015, 1, 1)


def version(kind, oid, n, visible=True, tags=None, at=None, nodes=None, members=None):
    return (kind, oid, n, 7, "u", T0 + dt.timedelta(days=n), 100 + n, visible, tags or {}, at and at[0], at and at[1], nodes, members)


def M(*parts):
    kinds = {"n": "NODE", "w": "WAY", "r": "RELATION"}
    return [(kinds[p[0]], int(p[1:].split(":")[0]), p.partition(":")[2]) for p in parts]


CASES = {
    "create node": ([version("NODE", 1, 1, at=(13.0, 46.0))], [("CREATE_NODE", 13.0, 46.0, "", "", -1, -1)]),
    "move node": ([version("NODE", 1, 1, at=(13.0, 46.0)), version("NODE", 1, 2, at=(13.5, 47.0))], [("MODIFY_COORDINATE", 13.5, 47.0, "", "", -1, -1)]),
    "add tag": ([version("NODE", 1, 1, at=(1.0, 1.0)), version("NODE", 1, 2, at=(1.0, 1.0), tags={"highway": "motorway"})], [("ADD_TAG", None, None, "highway", "motorway", -1, -1)]),
    "remove tags": (
        [version("NODE", 1, 1, at=(1.0, 1.0), tags={"highway": "x", "maxspeed": "50", "oneway": "yes"}), version("NODE", 1, 2, at=(1.0, 1.0), tags={"highway": "x"})],
        [("REMOVE_TAG", None, None, "maxspeed", "", -1, -1), ("REMOVE_TAG", None, None, "oneway", "", -1, -1)],
    ),
    "modify tags": (
        [version("NODE", 1, 1, at=(1.0, 1.0), tags={"maxspeed": "50", "oneway": "yes"}), version("NODE", 1, 2, at=(1.0, 1.0), tags={"maxspeed": "60", "oneway": "no"})],
        [("MODIFY_TAG_VALUE", None, None, "maxspeed", "60", -1, -1), ("MODIFY_TAG_VALUE", None, None, "oneway", "no", -1, -1)],
    ),
    "delete node": ([version("NODE", 1, 1, at=(13.0, 46.0)), version("NODE", 1, 2, visible=False)], [("DELETE_NODE", None, None, "", "", -1, -1)]),
    "recreate node": ([version("NODE", 1, 1, visible=False), version("NODE", 1, 2, at=(13.0, 46.0))], [("RECREATE_NODE", 13.0, 46.0, "", "", -1, -1)]),
    "delete way": ([version("WAY", 2, 1, nodes=[1, 2]), version("WAY", 2, 2, visible=False, nodes=[])], [("REMOVE_NODE", None, None, "", "", 2, 1), ("REMOVE_NODE", None, None, "", "", 1, 0), ("DELETE_WAY", None, None, "", "", -1, -1)]),
    "delete relation": ([version("RELATION", 3, 1, members=M("n1")), version("RELATION", 3, 2, visible=False, members=[])], [("REMOVE_MEMBER", None, None, "", "", 0, 0), ("DELETE_RELATION", None, None, "", "", -1, -1)]),
    "create way": ([version("WAY", 2, 1, nodes=[1, 2, 3, 4])], [("CREATE_WAY", None, None, "", "", -1, -1), *(("ADD_NODE", None, None, "", "", n, n - 1) for n in (1, 2, 3, 4))]),
    "add node": ([version("WAY", 2, 1, nodes=[1, 2, 3]), version("WAY", 2, 2, nodes=[1, 2, 3, 4])], [("ADD_NODE", None, None, "", "", 4, 3)]),
    "remove node": ([version("WAY", 2, 1, nodes=[1, 2, 3, 4]), version("WAY", 2, 2, nodes=[1, 2, 3])], [("REMOVE_NODE", None, None, "", "", 4, 3)]),
    "replace nodes": (
        [version("WAY", 2, 1, nodes=[1, 2, 3, 4]), version("WAY", 2, 2, nodes=[1, 5, 6, 3])],
        [("REMOVE_NODE", None, None, "", "", 4, 3), ("REMOVE_NODE", None, None, "", "", 2, 1), ("ADD_NODE", None, None, "", "", 5, 1), ("ADD_NODE", None, None, "", "", 6, 2)],
    ),
    "reorder nodes": ([version("WAY", 2, 1, nodes=[1, 2, 3]), version("WAY", 2, 2, nodes=[1, 3, 2])], [("REORDER_NODE", None, None, "", "", 2, 1)]),
    "create relation": ([version("RELATION", 3, 1, members=M("n1", "n2"))], [("CREATE_RELATION", None, None, "", "", -1, -1), ("ADD_MEMBER", None, None, "n", "", 1, 0), ("ADD_MEMBER", None, None, "n", "", 2, 1)]),
    "add way member": ([version("RELATION", 3, 1, members=M("w1")), version("RELATION", 3, 2, members=M("w1", "w4"))], [("ADD_MEMBER", None, None, "w", "", 4, 1)]),
    "add relation member": ([version("RELATION", 3, 1, members=M("r1")), version("RELATION", 3, 2, members=M("r1", "r4"))], [("ADD_MEMBER", None, None, "r", "", 4, 1)]),
    "remove way member": ([version("RELATION", 3, 1, members=M("n1", "w2", "w3", "w4")), version("RELATION", 3, 2, members=M("n1", "w2", "w3"))], [("REMOVE_MEMBER", None, None, "", "", 0, 3)]),
    "replace members": (
        [version("RELATION", 3, 1, members=M("w1", "w2", "r3", "r4")), version("RELATION", 3, 2, members=M("w1", "w5", "r6", "r3"))],
        [("REMOVE_MEMBER", None, None, "", "", 0, 3), ("REMOVE_MEMBER", None, None, "", "", 0, 1), ("ADD_MEMBER", None, None, "w", "", 5, 1), ("ADD_MEMBER", None, None, "r", "", 6, 2)],
    ),
    "insert into outer and inner": (
        [version("RELATION", 879, 1, members=M("n315642822", "w4870766:outer", "w8154192:inner", "w25692566")), version("RELATION", 879, 2, members=M("n315642822", "n315642830", "w4870766:outer", "w8154192:inner", "w25692566"))],
        [("ADD_MEMBER", None, None, "n", "", 315642830, 1)],
    ),
    "modify role": ([version("RELATION", 3, 1, members=M("n1", "n2", "n3")), version("RELATION", 3, 2, members=M("n1", "n2:newrole", "n3"))], [("MODIFY_ROLE", None, None, "", "newrole", -1, 1)]),
    "reorder members": ([version("RELATION", 3, 1, members=M("n1", "n2", "n3")), version("RELATION", 3, 2, members=M("n1", "n3", "n2"))], [("REORDER_MEMBER", None, None, "", "", 2, 1)]),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = []
    for i, (versions, _) in enumerate(CASES.values()):
        rows += [(v[0], v[1] * 1000 + i, *v[2:]) for v in versions]
    out = {}
    for r in version_diff(spark.createDataFrame(rows, ELEMENT_VERSIONS)).orderBy("oid", "version", "seq").collect():
        out.setdefault(r.oid % 1000, []).append(r)
    return out


@pytest.mark.parametrize("case", list(CASES))
def test_case(found, case):
    versions, want = CASES[case]
    last = max(v[2] for v in versions)
    got = [(r.operation_type.removeprefix("OP_"), r.lon, r.lat, r.key, r.value, r.ref_id, r.position) for r in found[list(CASES).index(case)] if r.version == last]
    assert got == want
    assert [r.seq for r in found[list(CASES).index(case)] if r.version == last] == list(range(len(want)))


def slow_moves(now, new):
    """Each place in turn gets the first item that fits of those behind it."""
    now, moves = list(now), []
    for to, wanted in enumerate(new):
        if now[to] != wanted:
            moves.append((now.index(wanted, to + 1), to))
            now.insert(to, now.pop(moves[-1][0]))
    return moves


def test_long_lists_are_reordered_in_little_time():
    import time

    n, began = 100_000, time.process_time()
    removed, added, moves, _ = list_edits(list(range(n)), list(range(n))[::-1], True)
    assert not removed and not added and moves == [(n - 1, i) for i in range(n - 1)]
    members = [("NODE", i, "a") for i in range(n)]
    assert len(member_edits(members, members[::-1])) == n - 1
    assert time.process_time() - began < 30


def test_lists_are_rebuilt_from_their_edits():
    import random

    r = random.Random(0)
    for _ in range(3000):
        old, new = ([r.randrange(5) for _ in range(r.randrange(7))] for _ in range(2))
        for first in (True, False):
            removed, added, moves, order = list_edits(old, new, first)
            again = [x for i, x in enumerate(old) if i not in removed]
            for i in added:
                again.insert(i, new[i])
            before = list(again)
            for a, b in moves:
                again.insert(b, again.pop(a))
            assert again == new == [before[i] for i in order]
            assert moves == slow_moves(before, new)


def test_repeated_nodes():
    # of a way's repeated node the first place counts as new, of a relation's member the last
    assert [(e[0], e[5], e[6]) for e in way_edits([1, 2], [1, 2, 1])] == [("OP_ADD_NODE", 1, 0), ("OP_REORDER_NODE", 2, 1)]
    assert [e[0] for e in member_edits([("NODE", 1, "")], [("NODE", 1, ""), ("NODE", 1, "")])] == ["OP_ADD_MEMBER"]
