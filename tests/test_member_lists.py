"""Lists of members become tuples as they stand, in slices of columns too."""

import pyarrow as pa

from editlens.operators.diff import member_tuples


def test_member_tuples():
    kind = pa.list_(pa.struct([("element_type", pa.string()), ("id", pa.int64()), ("role", pa.string())]))
    rows = [[("NODE", 1, "a"), ("WAY", 2, None)], [], [("RELATION", 3, "")], [("NODE", 1, "b")]]
    column = pa.array([[dict(zip(("element_type", "id", "role"), m)) for m in r] for r in rows], kind)
    assert member_tuples(column) == rows
    assert member_tuples(column.slice(2)) == rows[2:]
    assert member_tuples(column.take(pa.array([3, 1, 0]))) == [rows[3], rows[1], rows[0]]
    assert member_tuples(column.slice(0, 0)) == []
