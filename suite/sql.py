"""Small pieces of DuckDB SQL shared by the oracles."""

from __future__ import annotations


def key(seed: object, *parts: str) -> str:
    """MD5 of ``seed:part:part``; a seed given as ``(expr)`` is SQL, anything else is text."""
    text = str(seed)
    head = f"CAST({text} AS VARCHAR)" if text.startswith("(") else f"'{text}'"
    return "md5(concat_ws(':', " + ", ".join([head, *[f"CAST({p} AS VARCHAR)" for p in parts]]) + "))"


def hex_number(text: str, start: int = 1, digits: int = 8) -> str:
    return f"CAST('0x' || substr({text}, {start}, {digits}) AS BIGINT)"


def uniform(seed: object, *parts: str, start: int = 1) -> str:
    return f"({hex_number(key(seed, *parts), start)} / 4294967296.0::DOUBLE)"


def with_views(names: str, body: str) -> str:
    """WITH clause of the named views followed by more CTEs or a SELECT."""
    parts = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names.split())
    text = body.strip()
    if text[:5].upper() == "WITH ":
        return f"WITH {parts}, {text[5:]}"
    return f"WITH {parts} {text}"


def recursive_views(names: str, body: str) -> str:
    parts = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names.split())
    return f"WITH RECURSIVE {parts}, {body.strip()}"


# Class c of ten from all 64 components: sizes of c, c + 10, c + 20, ...
_FOLDED = ", ".join(" + ".join(f"abs(CAST(embedding[{i}] AS DOUBLE))" for i in range(c, 65, 10)) for c in range(1, 11))

VIEWS = {
    "v_manifest": """
SELECT 'slide_' || CAST(o_orderkey AS VARCHAR) AS slide_id,
       'slides/slide_' || CAST(o_orderkey AS VARCHAR) || '.SVS' AS filename,
       CAST(o_custkey AS VARCHAR) AS group_id, o_orderstatus AS label, o_orderpriority AS site
FROM orders""",
    "v_group": """
SELECT group_id, label FROM (
  SELECT group_id, label, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, label) AS r
  FROM (SELECT group_id, label, count(*) AS n FROM v_manifest GROUP BY 1, 2)) WHERE r = 1""",
    "v_pred": """
SELECT event_id AS slide_id, user_id AS patient_id, CAST(event_id % 5 AS INT) AS fold, label,
       (value + 20 * label) / (value + 20 * label + 50.0) AS prob_1
FROM (SELECT *, CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS label FROM events)""",
    "v_pred_multi": f"""
SELECT slide_id, label, list_transform(a, lambda x: x / total) AS probs
FROM (SELECT *, a[1] + a[2] + a[3] + a[4] + a[5] + a[6] + a[7] + a[8] + a[9] + a[10] AS total FROM (
  SELECT vec_id AS slide_id, label, [{_FOLDED}] AS a FROM embeddings))""",
    "v_patches": """
SELECT l_suppkey AS slide_id,
       CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity,
            l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS INT) AS patch_idx,
       CAST((l_partkey % 64) * 256 AS INT) AS x, CAST(l_quantity * 256 AS INT) AS y,
       l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3
FROM lineitem""",
    "v_embed": """
SELECT vec_id // 25 AS slide_id, CAST(vec_id % 25 AS INT) AS patch_idx,
       list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS features, label
FROM embeddings""",
    "v_timing": "SELECT event_type AS phase, value AS ms FROM events",
}
