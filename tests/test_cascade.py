"""Deletions by the declared keys."""

import random
from types import SimpleNamespace

import pytest

from plebis import schema
from plebis.operators import maintain


def tables(spark, rng):
    """Every table with twenty rows that name random rows of their parents."""
    out = {}
    for name in {*schema.FOREIGN_KEYS, *(p for keys in schema.FOREIGN_KEYS.values() for p in keys.values())}:
        keys = schema.FOREIGN_KEYS.get(name, {})
        rows = [(i, *(rng.choice([*range(20), None]) if c == "district_id" else rng.randrange(20) for c in keys)) for i in range(20)]
        out[name] = spark.createDataFrame(rows, ", ".join(["id long", *(f"{c} long" for c in keys)]))
    return SimpleNamespace(**out)


@pytest.mark.parametrize("root", ["county", "election", "person", "polling_station", "electoral_district"])
def test_no_orphans_are_left_and_nothing_else_goes(spark, root):
    t = tables(spark, random.Random(root))
    left = maintain.cascade(t, root, spark.createDataFrame([(3,), (3,), (99,)], "id long"))
    rows = {n: {r["id"]: r for r in getattr(t, n).collect()} for n in vars(t)}
    gone = {root: {3}}
    changed = True
    while changed:
        changed = False
        for name, keys in schema.FOREIGN_KEYS.items():
            for i, r in rows[name].items():
                if i not in gone.setdefault(name, set()) and any(r[c] in gone.get(p, ()) for c, p in keys.items()):
                    gone[name].add(i)
                    changed = True
    for name in rows:
        kept = {r["id"] for r in left[name].collect()} if name in left else set(rows[name])
        assert kept == set(rows[name]) - gone.get(name, set()), name


def test_order_and_circles():
    order = maintain.dependents("county")
    assert order[0] == "county" and order.index("municipality") < order.index("polling_station") < order.index("turnout")
    with pytest.raises(ValueError, match="circle"):
        maintain.dependents("r", {"a": {"x": "b", "r_id": "r"}, "b": {"y": "a"}})
