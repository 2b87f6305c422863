"""The star tables as a graph, in SQL."""

from __future__ import annotations

from vergraph.functions.text import STOP_WORDS
from vergraph.schema import VALID_ENDPOINTS
from vergraph.sources.star import SEED_VERSION

CENTS = "CAST(round({} * 100) AS BIGINT)"
PARTS = {
    "entities": f"""
  SELECT 'region-' || r_regionkey AS id, 'home' AS entity_type, r_name AS name, '{{}}' AS content FROM region
  UNION ALL SELECT 'nation-' || n_nationkey, 'zone', n_name, '{{}}' FROM nation
  UNION ALL SELECT 'supplier-' || s_suppkey, 'room', s_name, '{{"balance":' || {CENTS.format("s_acctbal")} || '}}' FROM supplier
  UNION ALL SELECT 'customer-' || c_custkey, 'room', c_name, '{{"segment":"' || c_mktsegment || '","balance":' || {CENTS.format("c_acctbal")} || '}}' FROM customer
  UNION ALL SELECT 'part-' || p_partkey, 'device', p_name, '{{"brand":"' || p_brand || '","type":"' || p_type || '","size":' || p_size || ',"capabilities":["' || p_type || '"]}}' FROM part
  UNION ALL SELECT 'order-' || o_orderkey, 'automation', o_orderpriority, '{{"status":"' || o_orderstatus || '","total":' || {CENTS.format("o_totalprice")} || '}}' FROM orders
  UNION ALL SELECT 'doc-' || doc_id, 'manual', coalesce(text, ''), '{{"lang":"' || lang || '","source":"' || source || '"}}' FROM documents""",
    "rels": """
  SELECT 'part_of' AS relationship_type, 'nation-' || n_nationkey AS src, 'region-' || n_regionkey AS dst, '{}' AS properties FROM nation
  UNION ALL SELECT 'located_in', 'supplier-' || s_suppkey, 'nation-' || s_nationkey, '{}' FROM supplier
  UNION ALL SELECT 'located_in', 'customer-' || c_custkey, 'nation-' || c_nationkey, '{}' FROM customer
  UNION ALL SELECT DISTINCT 'located_in', 'part-' || l_partkey, 'supplier-' || l_suppkey, '{}' FROM lineitem
  UNION ALL SELECT DISTINCT 'automates', 'order-' || l_orderkey, 'part-' || l_partkey, '{}' FROM lineitem
  UNION ALL SELECT 'connects_to', 'customer-' || c_custkey, 'supplier-' || s_suppkey, '{"via":"lane-' || s_suppkey || '"}' FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 10 = s_suppkey % 10
  UNION ALL SELECT 'connects_to', 'nation-' || n_nationkey, 'nation-' || nxt, '{}' FROM (SELECT n_nationkey, coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), min(n_nationkey) OVER (PARTITION BY n_regionkey)) AS nxt FROM nation) WHERE nxt <> n_nationkey
  UNION ALL SELECT 'documented_by', 'part-' || p_partkey, 'doc-' || (p_partkey % (SELECT count(*) FROM documents)), '{}' FROM part""",
    "vers": """
  SELECT 'user-' || user_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00-' || lpad(CAST(event_id AS VARCHAR), 6, '0') || '-' || event_type AS version,
    'note' AS entity_type, 'User ' || user_id AS name, '{"kind":"' || event_type || CASE WHEN event_type = 'error' THEN '","deleted":true}' ELSE '"}' END AS content,
    event_type AS user_id, epoch_us(ts) AS us, event_id + 1 AS server_seq, event_type = 'error' AS deleted, value FROM events""",
    "cur": """
  SELECT * FROM vers QUALIFY row_number() OVER (PARTITION BY id ORDER BY server_seq DESC) = 1""",
    "valid": "\n  SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, v in VALID_ENDPOINTS.items() for a, b in v) + ") t(relationship_type, from_type, to_type)",
    "ways": """
  SELECT src AS at_id, dst AS id, relationship_type, 'outgoing' AS direction FROM rels UNION ALL SELECT dst, src, relationship_type, 'incoming' FROM rels""",
}
NEEDS = {"cur": ["vers"], "ways": ["rels"]}


def sql(body: str, *parts: str, recursive: str = "") -> str:
    """``body`` behind the common table expressions it names."""
    order: list[str] = []
    for p in parts:
        for q in [*NEEDS.get(p, []), p]:
            if q not in order:
                order.append(q)
    tables = [f"{p} AS ({PARTS[p]})" for p in order]
    if recursive:
        tables.append(recursive)
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(tables) + "\n" if tables else "") + body


def tokens(text: str) -> str:
    """The engine's tokens of a text."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND NOT list_contains([{stop}], w)))"


PIN = SEED_VERSION
