"""The planning layer: what a refresh writes, and that what it leaves is the base built anew."""

import os

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from planforge.operators import planning as P
from planforge.plans import adapters as A
from planforge.plans import layers


@pytest.fixture()
def tables(sf_dir, tmp_path):
    """A copy of the given tables, of the orders of one year only."""
    orders = pq.read_table(f"{sf_dir}/orders.parquet")
    orders = orders.filter(pc.equal(pc.year(orders["o_orderdate"]), 1996))
    line = pq.read_table(f"{sf_dir}/lineitem.parquet")
    line = line.filter(pc.is_in(line["l_orderkey"], orders["o_orderkey"]))
    for name in ("region", "nation", "supplier", "part"):
        pq.write_table(pq.read_table(f"{sf_dir}/{name}.parquet"), tmp_path / f"{name}.parquet")
    pq.write_table(orders, tmp_path / "orders.parquet")
    pq.write_table(line, tmp_path / "lineitem.parquet")
    return str(tmp_path)


def rewrite(tables, name, change):
    path = f"{tables}/{name}.parquet"
    old = pq.read_table(path)
    os.remove(path)
    pq.write_table(change(old), path)


def files(layer):
    return {d: sorted(f for f in os.listdir(f"{layer.path}/{d}") if f.endswith(".parquet")) for d in os.listdir(layer.path) if d.startswith("month_key=")}


def rows(df):
    names = sorted(df.columns)
    return sorted(map(str, (tuple(r[c] if not isinstance(r[c], float) else round(r[c], 9) for c in names) for r in df.collect())))


def anew(spark, tables):
    return layers.build(spark, tables, A.lines(spark, tables).select(*layers.NEEDED))[0]


def months_of(line, orders):
    """Months of shipment and of order of some lines."""
    both = line.join(orders, "l_orderkey", right_keys="o_orderkey")
    return {int(pc.year(d).as_py() * 100 + pc.month(d).as_py()) for c in ("l_shipdate", "o_orderdate") for d in both[c]}


def test_refresh_rewrites_only_months_that_changed(spark, tables):
    layer = layers.Planning(spark, tables)
    first = layer.refresh()
    assert len(first) > 12 and layer.refresh() == []
    assert rows(layer.read()) == rows(anew(spark, tables))
    before = files(layer)

    key = pq.read_table(f"{tables}/lineitem.parquet")["l_orderkey"][0].as_py()
    is_it = lambda t: pc.equal(t["l_orderkey"], key)
    given = pq.read_table(f"{tables}/lineitem.parquet")
    expected = months_of(given.filter(is_it(given)), pq.read_table(f"{tables}/orders.parquet"))
    rewrite(tables, "lineitem", lambda t: t.set_column(t.schema.get_field_index("l_quantity"), "l_quantity", pc.cast(pc.if_else(is_it(t), pc.add(t["l_quantity"], 1), t["l_quantity"]), t["l_quantity"].type)))
    assert set(layer.refresh()) == expected
    after = files(layer)
    assert {d for d in before if before[d] != after.get(d)} <= {f"month_key={m}" for m in expected}
    assert {d for d in before if before[d] == after.get(d)} == {d for d in before if int(d[10:]) not in expected}
    assert rows(layer.read()) == rows(anew(spark, tables))


def test_months_go_with_their_lines_and_come_back(spark, tables):
    layer = layers.Planning(spark, tables)
    layer.refresh()
    kept = pq.read_table(f"{tables}/lineitem.parquet")
    rewrite(tables, "lineitem", lambda t: t.filter(pc.less(t["l_shipdate"], pa.scalar(pq.read_table(f"{tables}/orders.parquet")["o_orderdate"].to_pylist()[0].replace(year=1996, month=11, day=1), t["l_shipdate"].type))))
    gone = layer.refresh()
    assert gone and not {d for d in files(layer) if int(d[10:]) > 199612}
    assert rows(layer.read()) == rows(anew(spark, tables))
    rewrite(tables, "lineitem", lambda t: kept)
    assert layer.refresh() == gone
    assert rows(layer.read()) == rows(anew(spark, tables))


def test_a_change_of_what_months_share_rewrites_all(spark, tables):
    layer = layers.Planning(spark, tables)
    first = layer.refresh()
    rewrite(tables, "part", lambda t: t.set_column(t.schema.get_field_index("p_brand"), "p_brand", pa.array(["Other"] * len(t))))
    assert layer.refresh() == first
    assert {r[0] for r in layer.read().select("platform").distinct().collect()} == {"Other"}


def test_a_refresh_that_was_cut_short_is_made_good(spark, tables, monkeypatch):
    layer = layers.Planning(spark, tables)
    layer.refresh()
    kept = pq.read_table(f"{tables}/lineitem.parquet")
    rewrite(tables, "lineitem", lambda t: t.slice(5))

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(layers.io, "add_months", lost)
        with pytest.raises(RuntimeError):
            layer.refresh()
    rewrite(tables, "lineitem", lambda t: kept)  # as before the lost refresh, whose folders are gone
    assert layer.refresh()
    assert rows(layer.read()) == rows(anew(spark, tables))


def test_filters_reach_folders_and_row_groups(spark, tables):
    df = layers.planning(spark, tables).where("month_key = 199606 and site_code = 'NATION_7'").select("gcm_pk")
    plan = df._jdf.queryExecution().toString()
    scan = plan[plan.index("== Physical Plan ==") :]
    assert "PartitionFilters: [isnotnull(month_key" in scan and "EqualTo(site_code,NATION_7)" in scan and "Exchange" not in scan


def test_no_lines_give_an_empty_layer(spark, tables):
    rewrite(tables, "lineitem", lambda t: t.slice(0, 0))
    layer = layers.Planning(spark, tables)
    assert layer.refresh() == []
    assert layers.planning(spark, tables).count() == 0 and "gcm_pk" in layer.read().columns


def test_digests_tell_nulls_and_repeats_apart(spark):
    rows_of = lambda *v: spark.createDataFrame([(x,) for x in v], "a string")
    digest = lambda df: df.agg(*layers._content(df, ["a"])).first()
    assert digest(rows_of("x", None)) == digest(rows_of(None, "x"))
    assert digest(rows_of("x", "x", "y")) != digest(rows_of("x", "y", "y"))
    assert digest(rows_of(None)) != digest(rows_of(""))
    assert rows_of().agg(F.count("*")).first()[0] == 0


def test_built_in_parts_the_layer_is_the_same_and_leaves_no_files(spark, tables, monkeypatch):
    assert layers.month_groups({3: 5, 1: 4, 2: 4}) == [[1, 2, 3]]
    monkeypatch.setattr(layers, "LINE_BYTES", 1)
    monkeypatch.setattr(layers, "LINES", 400)
    monkeypatch.setattr(layers, "MOST_PARTS", (3, 4))
    assert layers.month_groups({3: 300, 1: 400, 2: 400, 4: 100}) == [[1], [2], [3, 4]]
    groups, build = [], layers.build_folded
    monkeypatch.setattr(layers, "build_folded", lambda *a: groups.append(a[3]) or build(*a))
    layer = layers.Planning(spark, tables)
    before = set(os.listdir(layers.io.shared_dir(spark))) if os.path.exists(layers.io.shared_dir(spark)) else set()
    months = layer.refresh()
    assert len(groups) > 2 and sorted(m for g in groups for m in g) == months
    assert rows(layer.read()) == rows(anew(spark, tables))
    left = {d.split("-")[0] for d in set(os.listdir(layers.io.shared_dir(spark))) - before}
    assert left <= {"layers", "cells", "folded"} and spark.conf.get(layers.io._CLEANUP) == "false"


def test_demand_and_test_times_are_dealt_once_each(spark, tables):
    about = P.about_products(A.hierarchy(spark, tables), A.products(spark, tables)).localCheckpoint()
    cells = P.with_demand(A.cells(A.lines(spark, tables).select(*layers.NEEDED), "product_number"), about).localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with layers.io.joined_where_dealt(spark):
            rows = P.planned_demand(cells).groupBy(*P.CELL).count()
            plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # test times, and the demand for children
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_parity_is_counted_without_a_layer(spark, tables, monkeypatch):
    from planforge.operators import analytics as N
    from planforge.queries import rollups

    part = pq.read_table(f"{tables}/part.parquet")
    rewrite(tables, "part", lambda t: pa.concat_tables([t, t.slice(3, 4)]))  # some products twice
    with monkeypatch.context() as m:
        m.setattr(layers, "COUNTED_LINES", 400)
        counted = rows(rollups.e8_parity_fan_out(spark, tables))
    layer = layers.Planning(spark, tables)
    assert layer.store.metadata("planning") is None and not os.path.isdir(layer.path)
    layer.refresh()
    assert len(counted) > 10 and counted == rows(N.parity_counts(layer.folded())) == rows(rollups.e8_parity_fan_out(spark, tables))
    rewrite(tables, "part", lambda t: part)
    assert rows(rollups.e8_parity_fan_out(spark, tables)) != counted  # the layer is of tables that were
