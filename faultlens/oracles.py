"""DuckDB twins of the telemetry views, used to write ``oracle_sql()``.

Each constant is one CTE body; ``with_views`` assembles the ones a query needs.
The SQL is written independently of the Spark code: it states the same
semantics with plain ANSI window functions, self-joins and aggregates.
"""

from __future__ import annotations

from faultlens.sources.telemetry import APP_CODES, EVENT_METRICS, LINEITEM_METRICS, VECTOR_DIMS

_APP_LIST = ", ".join(str(a) for a in APP_CODES)

VIEWS: dict[str, str] = {}

VIEWS["readings"] = f"""
  SELECT 'N' || CAST(user_id AS VARCHAR) AS node, user_id AS node_no, event_type AS metric,
         ts, value, event_id,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 AS fault,
         [{_APP_LIST}][TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 + 1] AS app
  FROM events"""

VIEWS["node_seconds"] = "\n  SELECT node, date_trunc('second', ts) AS ts,\n" + ",\n".join(
    f"         avg(value) FILTER (WHERE metric = '{m}') AS {m}" for m in EVENT_METRICS) + """,
         max(fault) AS fault, max(app) AS app
  FROM readings GROUP BY node, date_trunc('second', ts)"""

VIEWS["ns_pos"] = """
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts) AS pos FROM node_seconds"""


def _interp(m: str) -> str:
    fwd = "(PARTITION BY node ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    bwd = "(PARTITION BY node ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    pv = f"last_value({m} IGNORE NULLS) OVER {fwd}"
    pp = f"last_value(CASE WHEN {m} IS NOT NULL THEN pos END IGNORE NULLS) OVER {fwd}"
    nv = f"first_value({m} IGNORE NULLS) OVER {bwd}"
    np_ = f"first_value(CASE WHEN {m} IS NOT NULL THEN pos END IGNORE NULLS) OVER {bwd}"
    return (f"CASE WHEN {m} IS NOT NULL THEN {m} "
            f"WHEN ({pv}) IS NOT NULL AND ({nv}) IS NOT NULL "
            f"THEN ({pv}) + (({nv}) - ({pv})) * (pos - ({pp})) / (({np_}) - ({pp})) "
            f"ELSE coalesce({pv}, {nv}) END AS {m}")


def _ffbf(c: str) -> str:
    return (f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY node ORDER BY pos "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER "
            f"(PARTITION BY node ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}")


VIEWS["node_table"] = ("\n  SELECT node, ts, pos, " + ", ".join(_ffbf(c) for c in ["fault", "app"]) + ",\n  "
                       + ",\n  ".join(_interp(m) for m in EVENT_METRICS) + "\n  FROM ns_pos")

_LI_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax"
VIEWS["windows_big"] = f"""
  SELECT l_suppkey AS node,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LI_ORDER}) AS pos,
         {", ".join(LINEITEM_METRICS)}, l_linenumber - 1 AS label
  FROM lineitem"""

VIEWS["predictions"] = """
  SELECT 'N' || CAST(user_id AS VARCHAR) AS node, user_id AS node_no, event_id,
         CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS INTEGER) AS y,
         CAST(CASE WHEN event_id % 7 = 0
              THEN (list_position(['click','error','purchase','signup','view'], event_type)) % 5
              ELSE list_position(['click','error','purchase','signup','view'], event_type) - 1 END AS INTEGER) AS pred
  FROM events"""

VIEWS["cpu_wide"] = """
  SELECT l_suppkey AS node, l_orderkey, l_partkey, l_linenumber,
         CAST(l_quantity AS DOUBLE) AS "cpu0/m",
         CASE WHEN l_orderkey % 7 <> 0 THEN CAST(l_extendedprice AS DOUBLE) END AS "cpu1/m",
         CAST(l_discount AS DOUBLE) AS "cpu2/m", CAST(l_tax AS DOUBLE) AS "cpu3/m",
         l_quantity * l_tax AS power, l_linenumber - 1 AS "faultLabel"
  FROM lineitem"""

VIEWS["ml_vectors"] = "\n  SELECT vec_id, 'N' || CAST(vec_id % 8 AS VARCHAR) AS node, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(VECTOR_DIMS)) + ", label\n  FROM embeddings"

# dependencies between views, in definition order
_DEPS = {"readings": [], "node_seconds": ["readings"], "ns_pos": ["node_seconds"],
         "node_table": ["ns_pos"], "windows_big": [], "predictions": [], "cpu_wide": [],
         "ml_vectors": []}


def with_views(*names: str, extra: list[tuple[str, str]] = ()) -> str:
    """``WITH`` clause defining the named views (and their dependencies), then ``extra`` CTEs."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in order] + [f"{n} AS (\n{body}\n)" for n, body in extra]
    return "WITH " + ",\n".join(parts) + "\n"
