"""Queries on pairs: what they return gives back every pair of parts, by itself."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from sievemark.plans import geometry as G

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
SIM = G._iou("own_w", "own_h", "bore_w", "bore_h")
#: Every pair of parts, and which pairs of members (a, b) the pairs of shapes stand for.
ALL = {
    "label_matrix": (G._PAIRS + "SELECT peg_id, socket_id, label, round(margin, 9) FROM matrix", "x.label, x.margin", "a.split = b.split"),
    "best_turn": (G._PAIRS + "SELECT peg_id, socket_id, turn FROM matrix", "x.turn", "a.split = b.split"),
    "loose_flag": (G._PAIRS + "SELECT peg_id, socket_id, round(max_gap, 9) FROM matrix WHERE label = 'compatible'", "x.max_gap", "a.split = b.split"),
    "similarity": (G._PAIRS + f"SELECT peg_id, socket_id, round({SIM}, 9) FROM matrix", "x.sim", "a.split = b.split"),
    "candidate_pool": (G._POOL + "SELECT peg_id, socket_id, round(sim, 9) FROM pool", "x.sim", "a.split = b.split AND a.part_id <> b.part_id"),
    "near_dup": (G._NEAR + "SELECT part_a, part_b, round(sim, 9) FROM near", "x.similarity", "a.split <> b.split"),
}


@pytest.mark.parametrize("name", ALL)
def test_pairs_and_members_give_all_pairs(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("part", "lineitem", "orders", "customer", "nation", "events", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    sql, values, met = ALL[name]
    want = sorted(tuple(r) for r in c.sql(sql).fetchall())
    one, two = ("shape_a", "shape_b") if name == "near_dup" else ("peg_shape", "socket_shape")
    entry.queries()[name](spark, str(DATA)).createOrReplaceTempView("found")
    near = "least(a.part_id, b.part_id), greatest(a.part_id, b.part_id)" if name == "near_dup" else "a.part_id, b.part_id"
    got = spark.sql(f"""SELECT DISTINCT {near}, {values} FROM found x JOIN found a ON a.{one} = x.{one} JOIN found b ON b.{one} = x.{two}
        WHERE x.part_id IS NULL AND a.part_id IS NOT NULL AND b.part_id IS NOT NULL AND {met}""")
    plain = lambda rows: [tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in rows]
    assert plain(sorted(tuple(r) for r in got.collect())) == plain(want) and want


@pytest.mark.parametrize("name", ["best_turn", "loose_flag", "similarity", "candidate_pool"])
def test_parts_have_their_number_of_links(spark, name):
    """As many pairs of parts as all-pairs SQL finds: in sum over shapes, and for each part, those that have none too."""
    import duckdb

    c = duckdb.connect()
    for t in ("part", "lineitem", "orders", "customer", "nation", "events", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = {}
    for peg, *_ in c.sql(ALL[name][0]).fetchall():
        want[peg] = want.get(peg, 0) + 1
    parts = [r[0] for r in c.sql("SELECT p_partkey FROM part").fetchall()]
    found = entry.queries()[name](spark, str(DATA)).collect()
    assert sum(r["n_pairs"] for r in found if r["part_id"] is None) == sum(want.values())
    assert {r["part_id"]: r["n_links"] for r in found if r["part_id"] is not None} == {p: want.get(p, 0) for p in parts}
