"""Registry of queries, the ratings views they read, and common table expressions of their SQL.

Every query names its columns with kinds (i: BIGINT, d: DOUBLE to 6 places, s: text, b: BOOLEAN); both sides are cast by them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinade.operators.split import assign_folds
from affinade.plans.evaluate import Context
from affinade.sources.ratings import event_ratings, star_ratings, supplier_features

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
CTES: dict[str, str] = {}
KINDS = {"i": "bigint", "d": "double", "s": "string", "b": "boolean"}
VIEWS = {"supp": star_ratings, "evt": event_ratings}


def cast_column(name: str, kind: str) -> Column:
    c = F.col(name).cast(KINDS[kind])
    return (F.round(c, 6) + F.lit(0.0) if kind == "d" else c).alias(name)


def cast_sql(name: str, kind: str) -> str:
    c = f"CAST({name} AS {KINDS[kind].replace('string', 'varchar')})"
    return f"round({c}, 6) + 0.0 AS {name}" if kind == "d" else f"{c} AS {name}"


def with_ctes(sql: str) -> str:
    """Put the expressions that a statement names, and those they name, before it."""
    found: dict[str, str] = {}

    def add(text: str) -> None:
        for name in re.findall(r"\b[a-z]\w*\b", text):
            if name in CTES and name not in found:
                add(CTES[name])
                found.setdefault(name, CTES[name])

    add(sql)
    return ("WITH " + ",\n".join(f"{n} AS ({s})" for n, s in found.items()) + "\n" if found else "") + sql


def query(columns: str, sql: str | None = None):
    kinds = dict(c.split(":") for c in columns.split())

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, sf_dir).select(*(cast_column(n, k) for n, k in kinds.items()))
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_ctes(f"SELECT {', '.join(cast_sql(n, k) for n, k in kinds.items())} FROM ({sql})")
        return f

    return add


def split(spark: SparkSession, sf_dir: str, view: str = "evt") -> DataFrame:
    """Persisted (it spills to disk): every query reads several folds of it, and many queries the same."""
    return assign_folds(VIEWS[view](spark, sf_dir)).persist()


def context(spark: SparkSession, sf_dir: str, view: str = "evt") -> Context:
    features = supplier_features(spark, sf_dir) if view == "supp" else None
    return Context.of(split(spark, sf_dir, view), features=features)


CTES |= {
    "supp": "SELECT o_custkey AS u, l_suppkey AS i, max(CAST(floor((l_quantity - 1) / 10) + 1 AS DOUBLE)) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "evt": "SELECT user_id AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS i, max(CAST(floor(least(value, 199.0) / 40) + 1 AS DOUBLE)) AS r FROM events GROUP BY 1, 2",
    "sfeat": "SELECT s_suppkey AS i, 'n' || n_nationkey AS feature FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey, 'r' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey",
}
for _v in VIEWS:
    CTES |= {
        f"{_v}_placed": f"SELECT u, i, r, row_number() OVER (PARTITION BY u ORDER BY md5(concat('42:', u, ':', i)), i) AS p, count(*) OVER (PARTITION BY u) AS n FROM {_v}",
        f"{_v}_sized": f"SELECT *, least(floor(n * CAST(0.2 AS DOUBLE)), n - 1) AS nt FROM {_v}_placed",
        f"{_v}_split": f"SELECT u, i, r, CASE WHEN p <= nt THEN 'test' WHEN p <= nt + least(floor(n * CAST(0.1 AS DOUBLE)), n - nt - 1) THEN 'val' ELSE 'train' END AS fold FROM {_v}_sized",
        f"{_v}_train": f"SELECT u, i, r FROM {_v}_split WHERE fold = 'train'",
        f"{_v}_val": f"SELECT u, i, r FROM {_v}_split WHERE fold = 'val'",
        f"{_v}_test": f"SELECT u, i, r FROM {_v}_split WHERE fold = 'test'",
        f"{_v}_items": f"SELECT DISTINCT i FROM {_v}",
        f"{_v}_users": f"SELECT DISTINCT u FROM {_v}",
        f"{_v}_mu": f"SELECT avg(r) AS mu FROM {_v}_train",
        f"{_v}_cnt": f"SELECT i, count(t.r) AS cnt FROM {_v}_items LEFT JOIN {_v}_train t USING (i) GROUP BY 1",
        f"{_v}_mass": f"SELECT i, cnt, row_number() OVER w AS pos, sum(cnt) OVER (w ROWS UNBOUNDED PRECEDING) AS cum, sum(cnt) OVER () AS total FROM {_v}_cnt WINDOW w AS (ORDER BY cnt DESC, i)",
        f"{_v}_grp": f"SELECT i, cnt, pos, CAST(cum AS DOUBLE) / total AS cum_share, CASE WHEN CAST(cum - cnt AS DOUBLE) / total < CAST(1 AS DOUBLE) / 3 THEN 'head' WHEN CAST(cum - cnt AS DOUBLE) / total < CAST(2 AS DOUBLE) / 3 THEN 'medium' ELSE 'long_tail' END AS grp FROM {_v}_mass",
        f"{_v}_rank": f"SELECT i, CAST(pos - 1 AS DOUBLE) / greatest((SELECT count(*) FROM {_v}_items) - 1, 1) AS pop_rank FROM {_v}_mass",
        f"{_v}_hist": f"SELECT u, count(*) AS hist FROM {_v}_train GROUP BY 1",
        f"{_v}_hgrp": f"SELECT u, hist, CASE WHEN hist <= q1 THEN 'sparse' WHEN hist <= q2 THEN 'medium' ELSE 'heavy' END AS grp FROM {_v}_hist, (SELECT quantile_cont(hist, CAST(1 AS DOUBLE) / 3) AS q1, quantile_cont(hist, CAST(2 AS DOUBLE) / 3) AS q2 FROM {_v}_hist)",
        f"{_v}_um": f"SELECT u, coalesce(avg(t.r), (SELECT mu FROM {_v}_mu)) AS mean, count(t.r) AS n FROM {_v}_users LEFT JOIN {_v}_train t USING (u) GROUP BY 1",
        f"{_v}_im": f"SELECT i, coalesce(avg(t.r), (SELECT mu FROM {_v}_mu)) AS mean, count(t.r) AS n FROM {_v}_items LEFT JOIN {_v}_train t USING (i) GROUP BY 1",
        f"{_v}_rel": f"SELECT u, i FROM {_v}_test WHERE r >= 4",
        f"{_v}_cells": f"SELECT u, i FROM {_v}_users, {_v}_items",
        f"{_v}_open": f"SELECT c.u, c.i FROM {_v}_cells c ANTI JOIN {_v}_train t ON c.u = t.u AND c.i = t.i",
        f"{_v}_pop": f"SELECT u, row_number() OVER (PARTITION BY u ORDER BY cnt DESC, i) AS rank, i, CAST(cnt AS DOUBLE) AS score FROM {_v}_open JOIN {_v}_cnt USING (i) QUALIFY rank <= 10",
        f"{_v}_imtop": f"SELECT u, row_number() OVER (PARTITION BY u ORDER BY round(mean, 9) DESC, i) AS rank, i, round(mean, 9) AS score FROM {_v}_open JOIN {_v}_im USING (i) QUALIFY rank <= 10",
        f"{_v}_randtop": f"SELECT u, row_number() OVER (PARTITION BY u ORDER BY round(s, 9) DESC, i) AS rank, i, round(s, 9) AS score FROM (SELECT u, i, CAST(CAST('0x' || substr(md5(concat('42:', u, ':', i)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS s FROM {_v}_open) QUALIFY rank <= 10",
        f"{_v}_lists": f"SELECT 'popularity' AS model, * FROM {_v}_pop UNION ALL SELECT 'item_mean', * FROM {_v}_imtop UNION ALL SELECT 'random', * FROM {_v}_randtop",
        f"{_v}_hits": f"SELECT u, rank, row_number() OVER (PARTITION BY u ORDER BY rank) AS h FROM {_v}_pop JOIN {_v}_rel USING (u, i)",
        f"{_v}_nrel": f"SELECT u, count(*) AS n_rel FROM {_v}_rel GROUP BY 1",
        f"{_v}_sums": f"SELECT u, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg, sum(h / rank) AS ap FROM {_v}_hits GROUP BY 1",
        f"{_v}_um10": f"SELECT u, n_rel, coalesce(hits, 0) / 10.0 AS precision, CAST(coalesce(hits, 0) AS DOUBLE) / n_rel AS recall, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit_rate, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda p: 1 / log2(p + 1))) AS ndcg, coalesce(ap, 0) / least(n_rel, 10) AS ap FROM {_v}_nrel LEFT JOIN {_v}_sums USING (u)",
    }
