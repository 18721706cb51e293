"""Every query of the catalogue against its SQL on the same tables."""

import datetime
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillframe.plans import catalogue
from quillframe.sources.tables import TABLES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return format(round(float(v), 6) + 0.0, ".9g")
    if isinstance(v, (int, np.integer)):
        return format(float(v), ".9g")
    return str(pd.Timestamp(v)) if isinstance(v, datetime.datetime) else str(v)


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_only_iterative_queries_lack_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"q_louvain", "q_extractiveness", "q_claim_slugs"}


def test_whole_queries_take_every_item_and_row(spark, duck):
    ids = lambda sql: {r[0] for r in duck.sql(sql).fetchall()}
    chunks = catalogue.QUERIES["q_bm25_local_chunks_all"](spark, FOLDER).toPandas()
    assert set(chunks["qid"]) == ids("SELECT item_id FROM benchmark")
    near = catalogue.QUERIES["q_knn_text_filter_all"](spark, FOLDER).toPandas()
    assert set(near["qid"]) == ids("SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0")
    assert (near["id"] % 10 == 3).any()


def test_louvain_clusters_every_edge(spark):
    got = {r.id: r.community for r in catalogue.QUERIES["q_louvain"](spark, FOLDER).collect()}
    edges = catalogue.QUERIES["q_multi_signal_edges"](spark, FOLDER).collect()
    light = {r.a for r in edges} | {r.b for r in edges}
    light -= {x for r in edges if r.total > 1 for x in (r.a, r.b)}
    assert light and any(got[r.a] == got[r.b] for r in edges if r.a in light or r.b in light)
    m, inside, weight = sum(r.total for r in edges), 0.0, {}
    for r in edges:
        inside += r.total * (got[r.a] == got[r.b])
        for x in (r.a, r.b):
            weight[got[x]] = weight.get(got[x], 0.0) + r.total
    assert inside / m - sum((w / (2 * m)) ** 2 for w in weight.values()) > 0.3
