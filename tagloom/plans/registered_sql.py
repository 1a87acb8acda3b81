"""DuckDB SQL for the registered queries: the same tables as common table expressions, written independently in SQL."""

from __future__ import annotations

import re

from ..bridge import LIMITS, PAGE_KEYS, PAGE_VALUES, RELATION_TYPES


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_T4 = "count(*) AS count_all, count(*) FILTER (WHERE otype='n') AS count_nodes, count(*) FILTER (WHERE otype='w') AS count_ways, count(*) FILTER (WHERE otype='r') AS count_relations"
_M4 = _T4.replace("otype", "mtype")

TABLES = {
    "object_tags": """
      SELECT 'n' AS otype, o_orderkey AS oid, o_custkey AS uid, 'status' AS key, o_orderstatus AS value FROM orders
      UNION ALL SELECT 'n', o_orderkey, o_custkey, 'priority', o_orderpriority FROM orders
      UNION ALL SELECT 'n', o_orderkey, o_custkey, 'year', year(o_orderdate)::VARCHAR FROM orders
      UNION ALL SELECT 'n', o_orderkey, o_custkey, 'urgent', 'yes' FROM orders WHERE o_orderpriority='1-URGENT'
      UNION ALL SELECT 'w', p_partkey, p_size::BIGINT, 'brand', p_brand FROM part
      UNION ALL SELECT 'w', p_partkey, p_size::BIGINT, 'type', p_type FROM part
      UNION ALL SELECT 'w', p_partkey, p_size::BIGINT, 'size', p_size::VARCHAR FROM part
      UNION ALL SELECT 'w', p_partkey, p_size::BIGINT, p_name, p_brand FROM part
      UNION ALL SELECT 'r', c_custkey, c_nationkey::BIGINT, 'type', c_mktsegment FROM customer
      UNION ALL SELECT 'r', c_custkey, c_nationkey::BIGINT, 'nation:code', c_nationkey::VARCHAR FROM customer""",
    "plain_tags": f"SELECT key, value, {_T4} FROM object_tags GROUP BY key, value",
    "key_users": "SELECT key, count(DISTINCT uid) AS users_all FROM object_tags GROUP BY key",
    "key_stats": """SELECT key, sum(count_all)::BIGINT AS count_all, sum(count_nodes)::BIGINT AS count_nodes, sum(count_ways)::BIGINT AS count_ways,
      sum(count_relations)::BIGINT AS count_relations, count(*) AS values_all, count(*) FILTER (WHERE count_nodes>0) AS values_nodes,
      count(*) FILTER (WHERE count_ways>0) AS values_ways, count(*) FILTER (WHERE count_relations>0) AS values_relations FROM plain_tags GROUP BY key""",
    "plain_keys": r"""SELECT *, CASE WHEN count_all > 100 AND characters IN ('plain','colon','letters') OR key LIKE '%name:%-%' OR count_all > 1000 THEN 'g'
        WHEN characters IN ('space','problem') OR count_all < 10 AND characters='rest' OR length(key) < 3 THEN 'b' ELSE 'u' END AS grade
      FROM (SELECT s.*, users_all, CASE WHEN regexp_matches(s.key, '^[a-z]([a-z_]*[a-z])?$') THEN 'plain'
        WHEN regexp_matches(s.key, '^[a-z][a-z_:]*[a-z]$') THEN 'colon'
        WHEN regexp_matches(s.key, '^[\p{L}\p{M}]([\p{L}\p{M}\p{N}_:]*[\p{L}\p{M}\p{N}])?$') THEN 'letters'
        WHEN regexp_matches(s.key, '\p{Z}') THEN 'space'
        WHEN regexp_matches(s.key, '[=+/&<>;@''"?%#\\,\p{C}]') THEN 'problem' ELSE 'rest' END AS characters
        FROM key_stats s JOIN key_users USING (key))""",
    "key_combinations": f"SELECT a.key AS key1, b.key AS key2, {_T4.replace('otype', 'a.otype')} FROM object_tags a JOIN object_tags b ON a.otype=b.otype AND a.oid=b.oid AND a.key<b.key GROUP BY a.key, b.key",
    "interesting_tags": f"SELECT key, '' AS value FROM key_stats WHERE count_all > {LIMITS['tags']} UNION SELECT key, value FROM plain_tags WHERE count_all > {LIMITS['tags']}",
    "frequent_tags": f"SELECT key, value FROM plain_tags WHERE count_all > {LIMITS['map']}",
    "interesting_rtypes": f"SELECT value AS rtype FROM plain_tags WHERE key='type' AND count_relations > {LIMITS['relations']}",
    "items": """SELECT otype, oid, key, value FROM object_tags JOIN interesting_tags USING (key, value)
      UNION SELECT otype, oid, o.key, '' FROM object_tags o JOIN interesting_tags i ON o.key=i.key AND i.value=''""",
    "tag_combinations": f"""SELECT a.key AS key1, a.value AS value1, b.key AS key2, b.value AS value2, {_T4.replace('otype', 'a.otype')} FROM items a JOIN items b
      ON a.otype=b.otype AND a.oid=b.oid AND a.key<b.key AND (a.value<>'' OR b.value<>'') GROUP BY ALL HAVING count(*) >= {LIMITS['combinations']}""",
    "members": """SELECT c_custkey AS oid, c_mktsegment AS rtype, CASE o_orderstatus WHEN 'O' THEN 'n' WHEN 'F' THEN 'w' ELSE 'r' END AS mtype,
      o_orderpriority AS role FROM customer JOIN orders ON o_custkey=c_custkey""",
    "plain_relation_types": """SELECT rtype, count, members_all, members_nodes, members_ways, members_relations FROM
      (SELECT c_mktsegment AS rtype, count(*) AS count FROM customer GROUP BY 1) LEFT JOIN (SELECT rtype, count(*) AS members_all,
      count(*) FILTER (WHERE mtype='n') AS members_nodes, count(*) FILTER (WHERE mtype='w') AS members_ways, count(*) FILTER (WHERE mtype='r') AS members_relations
      FROM members GROUP BY rtype) USING (rtype)""",
    "relation_types": """SELECT * FROM plain_relation_types UNION ALL SELECT value, count_relations, NULL, NULL, NULL, NULL FROM plain_tags
      WHERE key='type' AND count_relations>0 AND value NOT IN (SELECT rtype FROM plain_relation_types)""",
    "relation_roles": f"SELECT rtype, role, {_M4} FROM members GROUP BY rtype, role",
    "prevalent_values": """SELECT t.key, t.value, t.count_all AS count, t.count_all / k.count_all::DOUBLE AS fraction FROM plain_tags t JOIN key_stats k USING (key)
      WHERE t.count_all > k.count_all / 100.0""",
    "prevalent_roles": "SELECT rtype, role, count_all AS count, round(count_all / members_all::DOUBLE, 4) AS fraction FROM relation_types JOIN relation_roles USING (rtype) WHERE count_all > members_all / 100.0",
    "cells": """SELECT o_orderkey AS oid, least(floor((lon + 180) / 360 * 360), 359)::INT AS x, least(floor((90 - lat) / 180 * 180), 179)::INT AS y FROM
      (SELECT o_orderkey, (o_custkey * 7919 + o_orderkey * 31) % 36000 / 100.0::DOUBLE - 180 AS lon, (o_orderkey * 104729 + o_custkey) % 18000 / 100.0::DOUBLE - 90 AS lat FROM orders)""",
    "way_cells": "SELECT DISTINCT p_partkey AS oid, x, y FROM part JOIN cells c ON c.oid IN (p_partkey, p_partkey + 32)",
    "grid_rows": "SELECT otype AS object_type, key, value, x, y FROM object_tags JOIN cells USING (oid) WHERE otype='n' UNION ALL SELECT otype, key, value, x, y FROM object_tags JOIN way_cells USING (oid) WHERE otype='w'",
    "key_grid": "SELECT key, object_type, x, y, count(*) AS count FROM grid_rows GROUP BY ALL",
    "tag_grid": "SELECT key, value, object_type, x, y, count(*) AS count FROM grid_rows JOIN frequent_tags USING (key, value) GROUP BY ALL",
    "similar_keys": """SELECT a.key AS key1, b.key AS key2, a.count_all AS count_all1, b.count_all AS count_all2, levenshtein(lower(a.key), lower(b.key))::INT AS similarity
      FROM key_stats a JOIN key_stats b ON a.key<b.key WHERE levenshtein(lower(a.key), lower(b.key)) <= 2""",
    "common_rare": f"""SELECT * FROM (SELECT key1 AS key_common, key2 AS key_rare, count_all1 AS count_all_common, count_all2 AS count_all_rare, similarity FROM similar_keys
      UNION ALL SELECT key2, key1, count_all2, count_all1, similarity FROM similar_keys) WHERE count_all_common >= {LIMITS['common'] // 10} AND count_all_rare BETWEEN 1 AND {LIMITS['rare']}""",
    "history": """SELECT ['n','w','r'][user_id % 3 + 1] AS otype, user_id AS oid, event_id AS version, event_id % 11 <> 0 AS visible, ts, event_type AS key,
      coalesce(floor(value / 50)::INT::VARCHAR, 'none') AS value FROM events""",
    "changes": """SELECT *, lag(CASE WHEN visible THEN key END) OVER w AS old_key, lag(CASE WHEN visible THEN value END) OVER w AS old_value,
      CASE WHEN visible THEN key END AS new_key, CASE WHEN visible THEN value END AS new_value FROM history WINDOW w AS (PARTITION BY otype, oid ORDER BY version)""",
    "key_steps": """SELECT otype, ts::DATE AS date, new_key AS key, 1 AS step FROM changes WHERE new_key IS NOT NULL AND old_key IS DISTINCT FROM new_key
      UNION ALL SELECT otype, ts::DATE, old_key, -1 FROM changes WHERE old_key IS NOT NULL AND old_key IS DISTINCT FROM new_key""",
    "tag_steps": """SELECT otype, ts::DATE AS date, new_key AS key, new_value AS value, 1 AS step FROM changes WHERE new_key IS NOT NULL AND (old_key IS DISTINCT FROM new_key OR old_value IS DISTINCT FROM new_value)
      UNION ALL SELECT otype, ts::DATE, old_key, old_value, -1 FROM changes WHERE old_key IS NOT NULL AND (old_key IS DISTINCT FROM new_key OR old_value IS DISTINCT FROM new_value)""",
}
for _n, _by in (("key", "key"), ("tag", "key, value")):
    TABLES[f"{_n}_chronology"] = f"""SELECT * FROM (SELECT {_by}, date, coalesce(sum(step) FILTER (WHERE otype='n'), 0)::BIGINT AS nodes, coalesce(sum(step) FILTER (WHERE otype='w'), 0)::BIGINT AS ways,
      coalesce(sum(step) FILTER (WHERE otype='r'), 0)::BIGINT AS relations FROM {_n}_steps GROUP BY {_by}, date) WHERE nodes<>0 OR ways<>0 OR relations<>0"""
TABLES |= {
    "wikipages": f"""SELECT *, CASE WHEN type='redirect' THEN 'r' WHEN NOT has_templ THEN 'p' WHEN parsed THEN 't' ELSE 'e' END AS status FROM (
      SELECT lang, {_list(PAGE_KEYS)}[doc_id % 8 + 1] AS key, CASE WHEN (doc_id // 8) % 2 = 1 THEN {_list(PAGE_VALUES)}[doc_id % 8 + 1] END AS value,
      'page ' || doc_id AS title, text AS body, split_part(text, chr(10), 1) AS description, CASE WHEN doc_id % 17 = 0 THEN 'redirect' ELSE 'page' END AS type, doc_id % 3 <> 0 AS has_templ,
      doc_id % 5 <> 0 AS parsed, CASE WHEN doc_id % 4 = 0 THEN 'File:i' || doc_id % 40 END AS image, doc_id % 2 = 0 AS on_node, CASE WHEN doc_id % 6 = 1 THEN 'File:r' || doc_id % 9 END AS rendering, doc_id, doc_id % 3 = 0 AS on_way, doc_id % 5 = 0 AS on_area, doc_id % 7 = 0 AS on_relation,
      CASE WHEN toxic=1 THEN 'deprecated' WHEN quality=1 THEN 'approved' WHEN quality=0 THEN 'proposed' END AS approval_status FROM documents LEFT JOIN labels USING (doc_id))""",
    "relation_pages": "SELECT *, coalesce(value, 'AUTOMOBILE') AS rtype FROM wikipages WHERE key='type'",
    "wiki_images": "SELECT image, (n + 1) * 25 AS width, (n % 7 + 1) * 60 AS height, n * 1000000 AS size, 'image/png' AS mime, 'https://images.example/' || image AS image_url, 'https://images.example/t/' || image || '/' AS thumb_url_prefix, 'px.png' AS thumb_url_suffix FROM (SELECT DISTINCT image, substr(image, 7)::INT AS n FROM wikipages WHERE image IS NOT NULL)",
    "page_langs": "SELECT key, value, coalesce(lang, '') || ':' || min(status) AS entry FROM wikipages GROUP BY key, value, coalesce(lang, '')",
    "wikipages_keys": "SELECT key, (SELECT string_agg(entry, ',' ORDER BY entry) FROM page_langs l WHERE l.key=w.key AND l.value IS NULL) AS langs, count(*) AS lang_count, CASE WHEN count(DISTINCT approval_status)<=1 THEN max(approval_status) END AS approval_status FROM wikipages w WHERE value IS NULL GROUP BY key",
    "wikipages_tags": "SELECT key, value, (SELECT string_agg(entry, ',' ORDER BY entry) FROM page_langs l WHERE l.key=w.key AND l.value=w.value) AS langs, count(*) AS lang_count, CASE WHEN count(DISTINCT approval_status)<=1 THEN max(approval_status) END AS approval_status FROM wikipages w WHERE value IS NOT NULL AND value<>'*' GROUP BY key, value",
    "inconsistent_keys": "SELECT DISTINCT a.key FROM wikipages a JOIN wikipages b ON a.key=b.key AND a.value IS NULL AND b.value IS NULL AND a.approval_status<>b.approval_status",
    "inconsistent_tags": "SELECT DISTINCT a.key, a.value FROM wikipages a JOIN wikipages b ON a.key=b.key AND a.value=b.value AND a.approval_status<>b.approval_status",
    "words": r"""SELECT key, value, string_agg(DISTINCT word, ',' ORDER BY word) AS words FROM (SELECT *, count(*) OVER (PARTITION BY word) AS n FROM (
      SELECT key, coalesce(value, '') AS value, lower(w) AS word FROM (SELECT key, value, unnest(list_distinct(regexp_extract_all(body, '[A-Za-z0-9_]+'))) AS w FROM wikipages)
      WHERE length(w) > 2 AND NOT regexp_matches(w, '[0-9]'))) WHERE n < 10 GROUP BY key, value""",
    "problems": "SELECT 'page content' AS location, 'parsing failed' AS reason, title, lang, key, value, NULL::VARCHAR AS info FROM wikipages WHERE status='e'",
    "projects": """SELECT s_name AS id, s_name AS name, 'nation ' || s_nationkey AS description, CASE WHEN s_suppkey % 10 = 1 THEN 'FATAL: no document at ' || s_name END AS error_log, (DATE '2024-01-01' + (s_suppkey % 9)::INT)::TIMESTAMP AS fetch_date, CASE s_suppkey % 10 WHEN 0 THEN 'FETCH ERROR' WHEN 1 THEN 'PARSE_ERROR' ELSE 'OK' END AS status,
      CASE WHEN s_suppkey % 3 = 0 THEN 'https://icons.example/i.png' END AS icon_url FROM supplier""",
    "project_tags": f"""SELECT *, 'uses ' || value AS description, CASE key WHEN 'brand' THEN 'https://doc.example/' || project_id END AS doc_url, CASE WHEN key <> 'brand' THEN 'https://icons.example/' || project_id END AS icon_url FROM (SELECT s_name AS project_id, CASE l_returnflag WHEN 'R' THEN 'brand' ELSE 'type' END AS key, CASE l_returnflag WHEN 'R' THEN p_brand WHEN 'N' THEN {_list(RELATION_TYPES)}[l_suppkey % 5 + 1] END AS value,
      bool_or(l_linestatus='O') AS on_node, bool_or(l_linestatus='F') AS on_way, bool_or(l_linestatus='F' OR l_returnflag='N') AS on_relation, bool_and(l_linestatus='O') AS on_area
      FROM lineitem JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey GROUP BY ALL)""",
    "unique_keys": """SELECT key, count(DISTINCT project_id) AS projects, coalesce(any_value(lang_count), 0) AS in_wiki, coalesce(any_value(count_all), 0)::BIGINT AS count_all
      FROM project_tags LEFT JOIN (SELECT key, lang_count FROM wikipages_keys) USING (key) LEFT JOIN (SELECT key, count_all FROM key_stats) USING (key) GROUP BY key""",
    "unique_tags": """SELECT key, value, count(DISTINCT project_id) AS projects, coalesce(any_value(lang_count), 0) AS in_wiki, coalesce(any_value(count_all), 0) AS count_all
      FROM project_tags LEFT JOIN (SELECT key, value, lang_count FROM wikipages_tags) USING (key, value) LEFT JOIN (SELECT key, value, count_all FROM plain_tags) USING (key, value) WHERE value IS NOT NULL GROUP BY key, value""",
    "discardable": f"SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN 'id' ELSE 'josm' END AS source, {_list(PAGE_KEYS)}[n_nationkey % 8 + 1] AS key FROM nation WHERE n_regionkey < 2",
    "every_key": "SELECT * FROM plain_keys UNION ALL BY NAME SELECT DISTINCT key, 0 AS count_all, 0 AS count_nodes, 0 AS count_ways, 0 AS count_relations, 0 AS values_all, 0 AS values_nodes, 0 AS values_ways, 0 AS values_relations, 0 AS users_all, 'u' AS grade FROM wikipages WHERE key NOT IN (SELECT key FROM plain_keys)",
    "keys": """SELECT k.*, k.key IN (SELECT key FROM wikipages WHERE value IS NULL) AS in_wiki, k.key IN (SELECT key FROM wikipages WHERE value IS NULL AND lang='en') AS in_wiki_en, projects
      FROM every_key k LEFT JOIN (SELECT key, projects FROM unique_keys) USING (key)""",
    "tags": """SELECT t.*, EXISTS (SELECT 1 FROM wikipages w WHERE w.key=t.key AND w.value=t.value AND w.value<>'*') AS in_wiki,
      EXISTS (SELECT 1 FROM wikipages w WHERE w.key=t.key AND w.value=t.value AND w.value<>'*' AND lang='en') AS in_wiki_en FROM plain_tags t""",
    "top_tags": """SELECT skey, svalue, count_all, count_nodes, count_ways, count_relations, coalesce(in_wiki, false) AS in_wiki, coalesce(in_wiki_en, false) AS in_wiki_en, projects FROM
      (SELECT key1 AS skey, value1 AS svalue FROM tag_combinations WHERE value1<>'' UNION SELECT key2, value2 FROM tag_combinations WHERE value2<>'')
      LEFT JOIN tags ON key=skey AND value=svalue LEFT JOIN (SELECT key AS k, value AS v, projects FROM unique_tags) ON k=skey AND v=svalue""",
    "popular": f"""SELECT key, count_all AS count, users_all AS users, (SELECT count(*) FROM wikipages w WHERE w.key=k.key) AS wikipages, k.key IN (SELECT key FROM wikipages) AS in_wiki,
      k.key IN (SELECT key FROM wikipages WHERE lang='en') AS in_wiki_en FROM plain_keys k WHERE count_all > {LIMITS['popular']}""",
    "popular_meta": "SELECT count(*) AS keys, min(count) AS count_min, max(count) AS count_max, max(count)-min(count) AS count_delta, min(users) AS users_min, max(users) AS users_max, max(users)-min(users) AS users_delta FROM popular",
    "popular_scores": """SELECT *, 10 * scale_count + 8 * scale_users + 2 * scale_wiki + 2 * scale_name AS scale1 FROM (SELECT popular.*,
      (count - count_min) / nullif(count_delta, 0)::DOUBLE AS scale_count, (users - users_min) / nullif(users_delta, 0)::DOUBLE AS scale_users,
      wikipages / (SELECT nullif(max(wikipages), 0) FROM popular)::DOUBLE AS scale_wiki, (key NOT LIKE '%:%')::INT::DOUBLE AS scale_name FROM popular, popular_meta)""",
    "suggestions": f"""SELECT *, count * (1 + in_wiki::INT * 9) AS score FROM (SELECT key, NULL AS value, count_all AS count, in_wiki FROM keys WHERE count_all >= {LIMITS['suggest']} OR in_wiki AND count_all >= 100
      UNION SELECT p.key, p.value, p.count, w.key IS NOT NULL FROM prevalent_values p LEFT JOIN (SELECT DISTINCT key, value FROM wikipages WHERE value IS NOT NULL) w ON p.key=w.key AND p.value=w.value
      WHERE (p.count>=1000 OR w.key IS NOT NULL AND p.count>=100) AND p.fraction>0.01 AND coalesce(try_cast(regexp_extract(p.value, '^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)', 1) AS DOUBLE), 0)=0 AND length(p.value)<=20)""",
    "languages": """SELECT code, english_name, native_name, (SELECT count(DISTINCT key) FROM wikipages WHERE lang=code AND value IS NULL) AS wiki_key_pages,
      (SELECT count(DISTINCT (key, value)) FROM wikipages WHERE lang=code AND value IS NOT NULL) AS wiki_tag_pages FROM
      (SELECT DISTINCT lang AS code, CASE WHEN lang IN ('en','de','fr') THEN 'language ' || lang END AS english_name, CASE WHEN lang IN ('en','de','fr') THEN upper(lang) END AS native_name FROM documents WHERE lang IS NOT NULL)""",
    "totals": """SELECT count(DISTINCT (otype, oid)) AS t_all, count(DISTINCT oid) FILTER (WHERE otype='n') AS t_nodes, count(DISTINCT oid) FILTER (WHERE otype='w') AS t_ways,
      count(DISTINCT oid) FILTER (WHERE otype='r') AS t_relations FROM object_tags""",
    "search_index": r"""SELECT field, u.t AS token, (u.i - 1)::INT AS pos, key, value, count_all FROM (
      SELECT 'key' AS field, key, value, count_all, list_filter(regexp_split_to_array(lower(key), '[^\p{L}\p{N}]+'), lambda x: x<>'') AS ts FROM plain_tags
      UNION ALL SELECT 'value', key, value, count_all, list_filter(regexp_split_to_array(lower(value), '[^\p{L}\p{N}]+'), lambda x: x<>'') FROM plain_tags),
      LATERAL (SELECT unnest(ts) AS t, generate_subscripts(ts, 1) AS i) u""",
}
_C4 = "count_all, count_nodes, count_ways, count_relations"
_F4 = ", ".join(f"round(count_{x} / t_{x}::DOUBLE, 4) AS count_{x}_fraction" for x in ("all", "nodes", "ways", "relations"))


def _union(rows: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS key, coalesce(({v}), 0)::BIGINT AS value FROM {source}" for k, v in rows.items())


def _by_type(name: str) -> dict[str, str]:
    return {f"num_{name}": "count(*)"} | {f"num_{name}_on_{x}": f"count(*) FILTER (WHERE count_{x}>0)" for x in ("nodes", "ways", "relations")}


_GRADES = {"bad": "b", "unknown": "u", "good": "g"}
_OBJECT = {
    "nodes": "(SELECT count(*) FROM orders)", "ways": "(SELECT count(*) FROM part)", "relations": "(SELECT count(*) FROM customer)",
    "objects": "(SELECT count(*) FROM orders) + (SELECT count(*) FROM part) + (SELECT count(*) FROM customer)",
    "node_tags": "(SELECT count(*) FROM object_tags WHERE otype='n')", "way_tags": "(SELECT count(*) FROM object_tags WHERE otype='w')",
    "relation_tags": "(SELECT count(*) FROM object_tags WHERE otype='r')", "object_tags": "(SELECT count(*) FROM object_tags)",
    "nodes_with_tags": "(SELECT count(*) FROM orders)", "closed_ways": "(SELECT count(*) FROM part WHERE p_size % 2 = 0)",
}
OBJECT_STATS = " UNION ALL ".join(f"SELECT '{k}' AS key, ({v})::BIGINT AS value" for k, v in _OBJECT.items())
DB_STATS = " UNION ALL ".join(
    [
        _union(_by_type("keys") | {f"grade_{n}": f"count(*) FILTER (WHERE grade='{g}')" for n, g in _GRADES.items()} | {f"grade_key_count_{n}": f"sum(count_all) FILTER (WHERE grade='{g}')" for n, g in _GRADES.items()}, "plain_keys"),
        "SELECT 'characters_in_keys_' || characters, count(*) FROM plain_keys GROUP BY characters",
        _union(_by_type("tags"), "plain_tags"),
        _union(_by_type("key_combinations"), "key_combinations"),
        _union({"relation_types_with_detail": "count(members_all)", "relation_types": "count(*)"}, "relation_types"),
        _union({"relation_roles": "count(*)"}, "relation_roles"),
        _union({"num_similar_keys": "count(*)"}, "similar_keys"),
        _union({"num_similar_keys_common_rare": "count(*)"}, "common_rare"),
        OBJECT_STATS,
    ]
)
_KINDS = {"": "true", "_redirect": "status='r'", "_without_template": "status='p'", "_with_template": "status='t'", "_with_error": "status='e'"}


def _pages(name: str, of: str) -> dict[str, str]:
    return {f"wiki_pages_for_{name}{k}": f"count(*) FILTER (WHERE ({of}) AND {v})" for k, v in _KINDS.items()}


WIKI_STATS = " UNION ALL ".join(
    [
        _union(_pages("keys", "value IS NULL") | _pages("tags", "value IS NOT NULL") | {"wiki_languages": "count(DISTINCT lang)", "wiki_keys_described": "count(DISTINCT key) FILTER (WHERE value IS NULL)", "wiki_tags_described": "count(DISTINCT (key, value)) FILTER (WHERE value IS NOT NULL AND value<>'*')"}, "wikipages"),
        _union(_pages("relation_types", "true"), "relation_pages"),
        _union({"wiki_images": "count(*)"}, "wiki_images"),
        _union({"wiki_inconsistent_status_keys": "count(*)"}, "inconsistent_keys"),
        _union({"wiki_inconsistent_status_tags": "count(*)"}, "inconsistent_tags"),
    ]
)


def _combined(key: str, n: str, query: str = "true") -> str:
    return f"""SELECT other_key, together_count, round(together_count / (SELECT {n} FROM keys WHERE key='{key}')::DOUBLE, 4) AS to_fraction, round(together_count / nullif({n}, 0)::DOUBLE, 4) AS from_fraction
      FROM (SELECT key2 AS other_key, {n} AS together_count FROM key_combinations WHERE key1='{key}' UNION ALL SELECT key1, {n} FROM key_combinations WHERE key2='{key}')
      LEFT JOIN keys ON key=other_key WHERE together_count>0 AND {query}"""


def _type_rows(source: str, values: bool) -> str:
    v = lambda x: f", coalesce(max(values_{x}), 0) AS values" if values else ""
    return " UNION ALL ".join(
        f"SELECT '{x}' AS type, coalesce(max(count_{x}), 0)::BIGINT AS count{v(x)}, round(coalesce(max(count_{x}), 0) / (SELECT t_{x} FROM totals)::DOUBLE, 4) AS count_fraction FROM {source}" for x in ("all", "nodes", "ways", "relations")
    )


def _prevalent(key: str, least: float) -> str:
    total = f"(SELECT count_all FROM keys WHERE key='{key}')"
    often = f"SELECT value, count_all AS count FROM plain_tags WHERE key='{key}' AND count_all > floor({total} * {least})"
    return f"""SELECT value, count, round(count / {total}::DOUBLE, 4) AS fraction FROM ({often}) UNION ALL
      SELECT NULL, {total} - s, round(({total} - s) / {total}::DOUBLE, 4) FROM (SELECT coalesce(sum(count), 0)::BIGINT AS s FROM ({often})) WHERE {total} > s"""


def _six(x: str) -> str:
    """A number with six decimals as text."""
    return f"({x})::DECIMAL(20,6)::VARCHAR"


def _list_text(entry: str) -> str:
    return f"string_agg({entry}, ',' ORDER BY {entry})"


_VALUE = "value || ':' || count || ':' || " + _six("round(fraction, 4)")
_COUNT_VALUE = "count || ':' || value || ':' || " + _six("round(fraction, 4)")
_ROLE_ENTRY = "role || ':' || count || ':' || " + _six("fraction")
_PAGE = "concat_ws(':', lang, title, status)"


def _described(of: str) -> str:
    """The first description of each language among some pages."""
    return f"""(SELECT coalesce(string_agg(lang || ':' || d || ':ltr', ',' ORDER BY lang || ':' || d), '') FROM (SELECT lang, arg_min(description, title) AS d FROM wikipages
      WHERE {of} AND description <> '' AND lang IS NOT NULL GROUP BY lang))"""


def _counts(source: str, values: bool) -> str:
    """The four rows of counts of a key or tag as text."""
    text = "type || ':' || count || ':' || " + _six("count_fraction") + (" || ':' || values" if values else "")
    return f"(SELECT {_list_text(text)} FROM ({_type_rows(source, values)}))"


def _overview(key: str, value: str | None) -> dict[str, str]:
    """The columns of a key's or tag's overview."""
    pages = f"key='{key}' AND " + ("value IS NULL" if value is None else f"value='{value}'")
    tag = f"key='{key}' AND value='{value}'"
    return {
        "key": f"'{key}'",
        "value": "NULL::VARCHAR" if value is None else f"'{value}'",
        "counts": _counts(f"keys WHERE key='{key}'", True) if value is None else _counts(f"plain_tags WHERE {tag}", False),
        "users": f"(SELECT users_all FROM keys WHERE key='{key}')",
        "projects": f"(SELECT count(DISTINCT project_id) FROM project_tags WHERE key='{key}')" if value is None else f"(SELECT coalesce(max(projects), 0) FROM unique_tags WHERE {tag})",
        "prevalent_values": f"(SELECT {_list_text(_COUNT_VALUE)} FROM prevalent_values WHERE key='{key}')",
        "wiki_pages": f"(SELECT coalesce({_list_text(_PAGE)}, '') FROM wikipages WHERE {pages})",
        "has_map": f"(SELECT count_nodes + count_ways > 0 FROM keys WHERE key='{key}')" if value is None else f"EXISTS (SELECT 1 FROM tag_grid WHERE {tag})",
        "description": _described(pages),
    }


def _select(columns: dict[str, str], *names: str) -> str:
    return "SELECT " + ", ".join(f"{columns[n]} AS {n}" for n in names)


_PAGES = """SELECT w.lang, CASE WHEN w.lang IS NULL THEN 'auto' ELSE 'ltr' END AS dir, coalesce(native_name, '(unknown)') AS language, coalesce(english_name, '(unknown)') AS language_en, title, description,
  w.image, width, height, size, mime, image_url, thumb_url_prefix, thumb_url_suffix, on_node, on_way, on_area, on_relation, approval_status, rendering
  FROM {0} w LEFT JOIN wiki_images i ON i.image=w.image LEFT JOIN languages ON code=w.lang WHERE {1}"""
_ENTRIES = """SELECT project_id, key, value, on_node, on_way, on_relation, on_area, p.description, name AS project_name, j.icon_url FROM project_tags p JOIN projects j ON id=project_id AND status='OK' WHERE {0}"""
_TAG_PAGES = """SELECT key, value, string_agg(lang || ':' || concat_ws(':', description, image, rendering), ',' ORDER BY lang || ':' || concat_ws(':', description, image, rendering)) AS wiki,
  arg_min(on_node, lang <> 'en' || lang) AS on_node, arg_min(on_way, (lang <> 'en')::VARCHAR || lang) AS on_way, arg_min(on_area, (lang <> 'en')::VARCHAR || lang) AS on_area, arg_min(on_relation, (lang <> 'en')::VARCHAR || lang) AS on_relation
  FROM (SELECT key, value, lang, arg_min(description, title) AS description, arg_min(image, title) AS image, arg_min_null(rendering, title) AS rendering, arg_min(on_node, title) AS on_node, arg_min(on_way, title) AS on_way, arg_min(on_area, title) AS on_area, arg_min(on_relation, title) AS on_relation
    FROM wikipages GROUP BY key, value, lang) GROUP BY key, value"""
_TAG_PAGES = _TAG_PAGES.replace("lang <> 'en' || lang", "(lang <> 'en')::VARCHAR || lang")
_LISTED = """SELECT w.key, w.value, coalesce(count_all, 0) AS count_all, coalesce(count_nodes, 0) AS count_nodes, coalesce(count_ways, 0) AS count_ways, coalesce(count_relations, 0) AS count_relations,
  wiki, on_node, on_way, on_area, on_relation, {1} FROM ({0}) w LEFT JOIN (""" + _TAG_PAGES + """) d ON d.key=w.key AND d.value IS NOT DISTINCT FROM w.value
  LEFT JOIN (SELECT key, value, count_all, count_nodes, count_ways, count_relations FROM plain_tags UNION ALL SELECT key, NULL, count_all, count_nodes, count_ways, count_relations FROM keys) c
  ON c.key=w.key AND c.value IS NOT DISTINCT FROM w.value, totals WHERE d.key IS NOT NULL OR c.key IS NOT NULL"""
_FILLED = ", ".join(f"round(coalesce(count_{x}, 0) / t_{x}::DOUBLE, 4) AS count_{x}_fraction" for x in ("all", "nodes", "ways", "relations"))
_ABOUT_KEYS = f"SELECT key, {_list_text(_PAGE)} AS wikipages FROM wikipages WHERE value IS NULL GROUP BY key"
_TOP10 = f"SELECT key, {_list_text(_VALUE)} AS prevalent_values FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY count DESC, value) AS n FROM prevalent_values) WHERE n<=10 GROUP BY key"
_ROLE = "SELECT role, " + ", ".join(f"count_{x} AS count_{y}_members, round(count_{x} / nullif(members_{x}, 0)::DOUBLE, 4) AS count_{y}_members_fraction" for x, y in (("all", "all"), ("nodes", "node"), ("ways", "way"), ("relations", "relation"))) + " FROM relation_roles JOIN relation_types USING (rtype)"
_STATUS = "SELECT coalesce(approval_status, 'none') AS status, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS k, count(*) FILTER (WHERE value IS NOT NULL) AS t FROM wikipages GROUP BY ROLLUP (coalesce(approval_status, 'none'))"

SQL = {
    "b0_explode_tags": "SELECT * FROM object_tags",
    "b1_tag_stats": "SELECT * FROM plain_tags",
    "b2_key_stats": "SELECT * FROM key_stats",
    "b3_key_users": "SELECT * FROM key_users",
    "b3_user_sketches": "SELECT key, users_all, true AS close FROM key_users",
    "b4_object_stats": OBJECT_STATS,
    "b5_key_combinations": "SELECT * FROM key_combinations",
    "b6_tag_combinations": "SELECT * FROM tag_combinations",
    "b7_relation_types": "SELECT * FROM plain_relation_types",
    "b8_relation_roles": "SELECT * FROM relation_roles",
    "b9_relation_types_topup": "SELECT * FROM relation_types",
    "b10_prevalent_values": "SELECT key, value, count, round(fraction, 8) AS fraction FROM prevalent_values",
    "b11_prevalent_roles": "SELECT * FROM prevalent_roles",
    "b12_key_grid": "SELECT * FROM key_grid",
    "b12_tag_grid": "SELECT * FROM tag_grid",
    "b13_key_cells": "SELECT key, count(*) FILTER (WHERE object_type='n') AS cells_nodes, count(*) FILTER (WHERE object_type='w') AS cells_ways FROM key_grid GROUP BY key",
    "b14_similar_keys": "SELECT key1, key2, similarity FROM similar_keys",
    "b15_similar_keys_counts": "SELECT * FROM similar_keys",
    "b16_similar_keys_common_rare": "SELECT * FROM common_rare",
    "b17_character_class": "SELECT key, characters FROM plain_keys",
    "b18_key_grade": "SELECT key, grade FROM plain_keys",
    "b19_db_stats": DB_STATS,
    "b21_interesting_tags": "SELECT * FROM interesting_tags",
    "b21_frequent_tags": "SELECT * FROM frequent_tags",
    "b21_interesting_relation_types": "SELECT * FROM interesting_rtypes",
    "b22_selection_stats": "SELECT 'interesting_tags' AS name, count(*) AS count FROM interesting_tags UNION ALL SELECT 'frequent_tags', count(*) FROM frequent_tags UNION ALL SELECT 'interesting_relation_types', count(*) FROM interesting_rtypes",
    "c1_key_chronology": "SELECT * FROM key_chronology",
    "c1_key_chronology_merged": "SELECT * FROM key_chronology",
    "c2_tag_chronology": "SELECT * FROM tag_chronology",
    "c2_tag_chronology_merged": "SELECT * FROM tag_chronology",
    "c2_object_states": "SELECT otype, oid, max(version) AS version, nullif(arg_max(CASE WHEN visible THEN key || ':' || value ELSE '' END, version), '') AS tags FROM history GROUP BY otype, oid",
    "c3_first_use": "SELECT key, floor(epoch(min(ts)))::BIGINT AS first_use FROM history WHERE visible GROUP BY key",
    "c4_smoothness": "SELECT key, round(1 - max(u) / nullif(sum(u), 0)::DOUBLE, 8) AS smoothness FROM (SELECT key, greatest(nodes + ways + relations, 0) AS u FROM key_chronology) GROUP BY key",
    "c5_cumulative": """SELECT key, date, sum(nodes + ways + relations) OVER (PARTITION BY key ORDER BY date)::BIGINT AS count FROM key_chronology
      UNION ALL SELECT DISTINCT key, DATE '2007-10-07', 0 FROM key_chronology UNION ALL SELECT key, DATE '2024-12-31', sum(nodes + ways + relations)::BIGINT FROM key_chronology GROUP BY key""",
    "c6_chronology_stats": """SELECT 'chronology_num_keys' AS key, count(DISTINCT key) AS value FROM key_chronology UNION ALL SELECT 'chronology_nodes', count(*) FROM history WHERE visible AND otype='n'
      UNION ALL SELECT 'chronology_ways', count(*) FROM history WHERE visible AND otype='w' UNION ALL SELECT 'chronology_relations', count(*) FROM history WHERE visible AND otype='r'""",
    "d13_page_status": "SELECT title, status FROM wikipages",
    "d14_wikipages_keys": "SELECT * FROM wikipages_keys",
    "d15_wikipages_tags": "SELECT * FROM wikipages_tags",
    "d16_inconsistent_keys": "SELECT * FROM inconsistent_keys",
    "d16_inconsistent_tags": "SELECT * FROM inconsistent_tags",
    "d17_wiki_languages": "SELECT lang AS language, count(*) AS count_pages FROM wikipages GROUP BY lang",
    "d18_wiki_stats": WIKI_STATS,
    "d19_image_titles": "SELECT image AS title FROM wikipages WHERE image IS NOT NULL UNION SELECT rendering FROM wikipages WHERE rendering IS NOT NULL",
    "d22_wiki_words": "SELECT * FROM words",
    "e3_project_counters": "SELECT p.id, p.name, p.description, p.status, p.icon_url, p.error_log, p.fetch_date, count(project_id) FILTER (WHERE value IS NULL) AS key_entries, count(value) AS tag_entries, count(DISTINCT key) AS unique_keys, count(DISTINCT (key, value)) FILTER (WHERE value IS NOT NULL) AS unique_tags FROM projects p LEFT JOIN project_tags ON project_id=id GROUP BY ALL",
    "e4_project_stats": _union({"projects": "count(*)", "projects_ok": "count(*) FILTER (WHERE status='OK')", "projects_fetch_error": "count(*) FILTER (WHERE status='FETCH ERROR')", "projects_parse_error": "count(*) FILTER (WHERE status='PARSE_ERROR')", "projects_with_icon": "count(icon_url)"}, "projects") + " UNION ALL " + _union({"project_keys": "count(*) FILTER (WHERE value IS NULL)", "project_tags": "count(value)"}, "project_tags"),
    "g2_sw_stats": "SELECT 'discardable_tags_' || source AS key, count(*) AS value FROM discardable GROUP BY source UNION ALL SELECT 'deprecated_tags_id', count(*) FROM discardable UNION ALL SELECT 'discardable_tags', count(DISTINCT key) FROM discardable",
    "m2_master_stats": f"SELECT DISTINCT key, value FROM ({DB_STATS} UNION ALL {WIKI_STATS})",
    "m3_project_unique_keys": "SELECT * FROM unique_keys",
    "m4_project_unique_tags": "SELECT * FROM unique_tags",
    "m5_keys": "SELECT * FROM keys",
    "m6_tags": "SELECT * FROM tags",
    "m7_top_tags": "SELECT * FROM top_tags",
    "m8_popular_keys": "SELECT * REPLACE (round(scale_count, 8) AS scale_count, round(scale_users, 8) AS scale_users, round(scale_wiki, 8) AS scale_wiki, round(scale1, 8) AS scale1) FROM popular_scores",
    "m9_popular_metadata": "SELECT * FROM popular_meta",
    "m10_popular_scores": "SELECT key, round(scale1, 8) AS scale1 FROM popular_scores",
    "m11_language_pages": "SELECT * FROM languages",
    "m12_suggestions": "SELECT * FROM suggestions",
    "m13_stats_series": "SELECT ts::DATE AS udate, count(*) AS value FROM events WHERE event_type='click' GROUP BY 1",
    "m14_search_index": "SELECT * FROM search_index",
    "m14_search_postings": "SELECT token, field, key, value, count_all, string_agg(pos::VARCHAR, ',' ORDER BY pos::VARCHAR) AS positions FROM search_index GROUP BY ALL",
    "d22_word_grams": """SELECT DISTINCT substr(part, i::INT, 3) AS gram, key, value FROM (SELECT key, value, w || coalesce(',' || substr(lead(w) OVER (PARTITION BY key, value ORDER BY w), 1, 2), '') AS part
      FROM (SELECT key, value, unnest(string_split(words, ',')) AS w FROM words)), LATERAL (SELECT unnest(range(1, length(part) - 1)) AS i) u""",
    "q1_key_combinations": _combined("priority", "count_all"),
    "q1_key_combinations_nodes": _combined("type", "count_relations", "lower(other_key) LIKE '%n%'"),
    "q2_key_similar": "SELECT key2 AS other_key, count_all2 AS count_all, similarity FROM similar_keys WHERE key1='old rod' UNION ALL SELECT key1, count_all1, similarity FROM similar_keys WHERE key2='old rod'",
    "q3_key_distribution": "SELECT x, y, count FROM key_grid WHERE key='urgent' AND object_type='n'",
    "q4_key_stats": _type_rows("keys WHERE key='type'", True),
    "q5_key_values": f"""SELECT t.value, {_C4}, count_all AS count, round(count_all / (SELECT count_all FROM keys WHERE key='brand')::DOUBLE, 4) AS fraction, in_wiki, coalesce(nullif(own, ''), nullif(english, '')) AS description,
      CASE WHEN own<>'' THEN 'de' WHEN english<>'' THEN 'en' END AS desclang, CASE WHEN own<>'' OR english<>'' THEN 'ltr' ELSE 'auto' END AS descdir FROM tags t LEFT JOIN
      (SELECT value, max(description) FILTER (WHERE lang='de') AS own, max(description) FILTER (WHERE lang='en') AS english FROM wikipages WHERE key='brand' AND value IS NOT NULL GROUP BY value) d ON d.value=t.value WHERE key='brand'""",
    "q6_prevalent_values": _prevalent("priority", 0.2),
    "q7_key_wiki_pages": _PAGES.format("wikipages", "key='type' AND value IS NULL"),
    "q8_key_projects": _ENTRIES.format("key='brand' AND (on_way OR on_area)"),
    "q9_key_chronology": "SELECT date, nodes, ways, relations FROM key_chronology WHERE key='click'",
    "q10_key_overview": _select(_overview("type", None), "key", "counts", "users", "projects", "prevalent_values", "wiki_pages", "has_map", "description"),
    "q11_keys_all": f"SELECT key, {_C4}, values_all, users_all, in_wiki, in_wiki_en, projects, {_F4}, prevalent_values, wikipages FROM keys CROSS JOIN totals LEFT JOIN ({_TOP10}) USING (key) LEFT JOIN ({_ABOUT_KEYS}) USING (key)",
    "q11_keys_filtered": f"SELECT key, {_C4}, values_all, users_all, in_wiki, in_wiki_en, projects, {_F4} FROM keys, totals WHERE characters='space' AND lower(key) LIKE '%r%'",
    "q12_keys_wiki_pages": "SELECT key, langs, lang_count FROM wikipages_keys",
    "q13_keys_similar": "SELECT * FROM common_rare WHERE similarity<>0 AND count_all_common>=20",
    "q14_keys_without_wiki_page": f"SELECT key, count_all, round(count_all / t_all::DOUBLE, 8) AS count_all_fraction, values_all, users_all, in_wiki, in_wiki_en, prevalent_values FROM keys CROSS JOIN totals LEFT JOIN ({_TOP10}) USING (key) WHERE count_all > 100 AND NOT in_wiki",
    "q15_keys_discardable": """SELECT key, coalesce(wiki, false) AS wiki, coalesce(id, false) AS id, coalesce(josm, false) AS josm, count_all FROM
      (SELECT key, true AS wiki FROM wikipages_keys WHERE approval_status IN ('approved','proposed')) FULL JOIN (SELECT key, bool_or(source='id') AS id, bool_or(source='josm') AS josm FROM discardable GROUP BY key) USING (key) JOIN (SELECT key, count_all FROM keys) USING (key)""",
    "q16_tag_combinations": """SELECT other_key, other_value, together_count, round(together_count / (SELECT count_all FROM plain_tags WHERE key='priority' AND value='1-URGENT')::DOUBLE, 4) AS to_fraction,
      round(together_count / CASE other_value WHEN '' THEN k.count_all ELSE t.count_all END::DOUBLE, 4) AS from_fraction FROM
      (SELECT key2 AS other_key, value2 AS other_value, count_all AS together_count FROM tag_combinations WHERE key1='priority' AND value1='1-URGENT'
       UNION ALL SELECT key1, value1, count_all FROM tag_combinations WHERE key2='priority' AND value2='1-URGENT') LEFT JOIN keys k ON k.key=other_key LEFT JOIN plain_tags t ON t.key=other_key AND t.value=other_value""",
    "q17_tag_distribution": "SELECT x, y, count FROM tag_grid WHERE key='status' AND value='P' AND object_type='n'",
    "q18_tag_stats": _type_rows("plain_tags WHERE key='priority' AND value='5-LOW'", False),
    "q19_tag_wiki_pages": _PAGES.format("wikipages", "key='type' AND value='BUILDING'"),
    "q20_tag_projects": _ENTRIES.format("key='brand' AND value IS NOT DISTINCT FROM (SELECT max(value) FROM project_tags b WHERE b.project_id=p.project_id AND b.key='brand' AND (b.value IS NULL OR b.value='Brand#11')) AND (value IS NULL OR value='Brand#11')"),
    "q21_tag_chronology": "SELECT date, nodes, ways, relations FROM tag_chronology WHERE key='click' AND value='0'",
    "q22_tag_overview": _select(_overview("status", "O"), "key", "value", "counts", "projects", "wiki_pages", "has_map", "description"),
    "q24_tags_popular": f"SELECT t.*, {_F4} FROM top_tags t, totals",
    "q25_relation_roles": _ROLE + " WHERE rtype='BUILDING'",
    "q26_relation_stats": " UNION ALL ".join(f"SELECT '{x}' AS type, coalesce(max(members_{x}), 0)::BIGINT AS count FROM relation_types WHERE rtype='BUILDING'" for x in ("all", "nodes", "ways", "relations")),
    "q27_relation_wiki_pages": _PAGES.format("relation_pages", "rtype='BUILDING'"),
    "q28_relation_projects": _ENTRIES.format("key='type' AND value='BUILDING' AND on_relation"),
    "q29_relations_all": f"SELECT rtype, count, round(count / (SELECT t_relations FROM totals)::DOUBLE, 8) AS count_fraction, (SELECT {_list_text(_ROLE_ENTRY)} FROM prevalent_roles p WHERE p.rtype=r.rtype) AS prevalent_roles FROM relation_types r",
    "q30_relations_roles": "SELECT * FROM relation_roles WHERE lower(role) LIKE '%u%'",
    "q31_search_key_and_value": "SELECT key, value, count_all FROM plain_tags WHERE list_contains(regexp_split_to_array(lower(key), '[^a-z0-9]+'), 'brand') AND list_contains(regexp_split_to_array(lower(value), '[^a-z0-9]+'), 'brand')",
    "q31_search_phrase": "SELECT DISTINCT a.key, a.value, a.count_all FROM search_index a JOIN search_index b ON a.key=b.key AND a.value=b.value AND a.field=b.field AND a.token='not' AND b.token='specified' AND b.pos=a.pos+1",
    "q32_search_keyword": "SELECT key, nullif(value, '') AS value FROM words WHERE words LIKE '%tion%'",
    "q33_search_role": "SELECT rtype, role, count_all FROM relation_roles WHERE lower(role) LIKE '%low%'",
    "q34_search_value": "SELECT DISTINCT key, value, count_all FROM search_index WHERE field='value' AND token='urgent'",
    "q35_suggest": "SELECT key, value, score FROM suggestions WHERE value IS NULL AND lower(key) LIKE 'p%' ORDER BY score DESC, key LIMIT 10",
    "q36_project_tags": """SELECT p.project_id, p.key, p.value, p.on_node, p.on_way, p.on_relation, p.on_area, p.description, p.doc_url, p.icon_url, coalesce(t.in_wiki, k.in_wiki) AS in_wiki, coalesce(t.count_all, k.count_all) AS count_all FROM project_tags p LEFT JOIN unique_tags t ON p.key=t.key AND p.value=t.value
      LEFT JOIN unique_keys k ON p.key=k.key AND p.value IS NULL WHERE project_id='Supplier#000000002'""",
    "q37_projects_all": "SELECT p.id, p.name, p.description, p.status, p.icon_url, p.error_log, p.fetch_date, count(project_id) FILTER (WHERE value IS NULL) AS key_entries, count(value) AS tag_entries, count(DISTINCT key) AS unique_keys, count(DISTINCT (key, value)) FILTER (WHERE value IS NOT NULL) AS unique_tags FROM projects p LEFT JOIN project_tags ON project_id=id WHERE status='OK' GROUP BY ALL",
    "q38_projects_keys": "SELECT *, round(projects / (SELECT count(*) FROM projects WHERE status='OK')::DOUBLE, 4) AS projects_fraction FROM unique_keys",
    "q39_projects_tags": "SELECT *, round(projects / (SELECT count(*) FROM projects WHERE status='OK')::DOUBLE, 4) AS projects_fraction FROM unique_tags WHERE key LIKE '%1%' OR value LIKE '%1%'",
    "q42_wiki_languages": "SELECT code, native_name, english_name, 'ltr' AS dir, wiki_key_pages, wiki_tag_pages, round(wiki_key_pages / (SELECT count(*) FROM wikipages_keys)::DOUBLE, 8) AS wiki_key_pages_fraction, round(wiki_tag_pages / (SELECT count(*) FROM wikipages_tags)::DOUBLE, 8) AS wiki_tag_pages_fraction FROM languages",
    "q43_wiki_key_status": "SELECT approval_status, key, string_agg(lang, ',' ORDER BY lang) AS languages FROM wikipages WHERE value IS NULL GROUP BY ALL",
    "q44_wiki_tag_status": "SELECT approval_status, key, value, string_agg(lang, ',' ORDER BY lang) AS languages FROM wikipages WHERE value IS NOT NULL AND approval_status IS NULL GROUP BY ALL",
    "q45_inconsistent_key_status": "SELECT key, string_agg(approval_status || ':' || n, ',' ORDER BY approval_status) AS statuses FROM (SELECT key, approval_status, count(*) AS n FROM wikipages WHERE value IS NULL AND approval_status IS NOT NULL AND key IN (SELECT key FROM inconsistent_keys) GROUP BY ALL) GROUP BY key",
    "q46_inconsistent_tag_status": "SELECT key, value, string_agg(approval_status || ':' || n, ',' ORDER BY approval_status) AS statuses FROM (SELECT key, value, approval_status, count(*) AS n FROM wikipages JOIN inconsistent_tags USING (key, value) WHERE approval_status IS NOT NULL GROUP BY ALL) GROUP BY key, value",
    "q47_wiki_problems": "SELECT * FROM problems WHERE lower(location || reason || title) LIKE '%page 1%'",
    "r1_key_lengths": "SELECT i::INT AS length, coalesce(n, 0) AS count FROM range(1, 61) x(i) LEFT JOIN (SELECT least(length(key), 60) AS l, count(*) AS n FROM plain_keys GROUP BY 1) ON l=i",
    "r2_characters_in_keys": "SELECT characters, count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM plain_keys), 2) AS percent FROM plain_keys GROUP BY characters",
    "r3_historic_development": "SELECT ts::DATE AS udate, nullif(count(*) FILTER (WHERE event_type='click'), 0) AS click, nullif(count(*) FILTER (WHERE event_type='view'), 0) AS view FROM events WHERE event_type IN ('click','view') GROUP BY 1",
    "r4_pages_about_missing_keys": f"SELECT key, {_C4}, values_all, users_all, in_wiki, in_wiki_en, projects, {_F4}, wikipages FROM keys CROSS JOIN totals LEFT JOIN ({_ABOUT_KEYS}) USING (key) WHERE in_wiki AND count_all=0",
    "r6_tag_cloud": "SELECT key, count, round(scale1, 8) AS scale1, rank, round(scale1 / 22 * 25 + (1 - (rank - 1) / 300.0::DOUBLE) * 10 + 8, 2) AS size FROM (SELECT *, row_number() OVER (ORDER BY scale1 DESC, key)::INT AS rank FROM popular_scores ORDER BY scale1 DESC, key LIMIT 300)",
    "r7_top_tags": "SELECT key, value, count_all FROM plain_tags WHERE key<>'status' ORDER BY count_all DESC, key, value LIMIT 30",
    "r7_top_relation_types": "SELECT rtype, count FROM relation_types ORDER BY count DESC, rtype LIMIT 30",
    "r8_status_table": f"""SELECT coalesce(a.status, 'total') AS status, a.n AS "all", a.n * 100 // b.n AS all_percent, a.k AS keys, a.k * 100 // nullif(b.k, 0) AS keys_percent, a.t AS tags, a.t * 100 // nullif(b.t, 0) AS tags_percent
      FROM ({_STATUS}) a, (SELECT * FROM ({_STATUS}) WHERE status IS NULL) b""",
    "r9_status_choices": "SELECT approval_status, count(DISTINCT key) FILTER (WHERE value IS NULL) AS keys, count(DISTINCT (key, value)) FILTER (WHERE value IS NOT NULL) AS tags FROM wikipages WHERE approval_status IS NOT NULL GROUP BY approval_status",
    "r10_frequent_statuses": "SELECT approval_status, count(*) AS pages FROM wikipages WHERE approval_status IS NOT NULL GROUP BY approval_status HAVING count(*) > 10",
    "r11_image_sizes": """SELECT kind, image, key, value, count(*) AS pages FROM wikipages JOIN wiki_images i USING (image), (VALUES ('small'), ('tall'), ('wide'), ('large')) v(kind)
      WHERE CASE kind WHEN 'small' THEN width<100 AND height<100 WHEN 'tall' THEN height // width >= 2 WHEN 'wide' THEN width // height >= 3 ELSE size > 20000000 END GROUP BY ALL""",
    "r13_language_comparison": "SELECT key, min(status) FILTER (WHERE lang='en') AS en, min(status) FILTER (WHERE lang='de') AS de FROM wikipages WHERE value IS NULL GROUP BY key",
    "r14_problems_by_lang": "SELECT lang, count(*) AS count FROM problems GROUP BY lang",
    "r15_object_ratios": "SELECT 100.0::DOUBLE AS tagged_nodes_percent, floor(n / (SELECT count(*) FROM orders)::DOUBLE * 100) / 100 AS tags_per_node, floor(w / (SELECT count(*) FROM part)::DOUBLE * 100) / 100 AS tags_per_way, floor(r / (SELECT count(*) FROM customer)::DOUBLE * 100) / 100 AS tags_per_relation FROM (SELECT count(*) FILTER (WHERE otype='n') AS n, count(*) FILTER (WHERE otype='w') AS w, count(*) FILTER (WHERE otype='r') AS r FROM object_tags)",
    "r16_discardable_by_source": "SELECT key, max((source='id')::INT) AS id, max((source='josm')::INT) AS josm FROM discardable GROUP BY key",
    "r20_project_overview": "SELECT id, name, status, fetch_date, date_diff('day', fetch_date, TIMESTAMP '2024-01-09') > 7 AS outdated, error_log FROM projects",
    "r22_embed_counts": " UNION ALL ".join(f"SELECT '{x}' AS type, count_{x}::BIGINT AS count FROM keys WHERE key='type'" for x in ("all", "nodes", "ways", "relations")),
    "r22_embed_roles": "SELECT role, count_all FROM relation_roles WHERE rtype='BUILDING' ORDER BY count_all DESC, role LIMIT 10",
    "r25_value_treemap": _prevalent("year", 0.002),
    "q23_tags_list": _LISTED.format("SELECT * FROM (VALUES ('status', 'O'), ('status', 'P'), ('priority', NULL)) v(key, value)", _FILLED),
    "q23_tags_of_key": _LISTED.format("SELECT DISTINCT key, value FROM wikipages WHERE key='brand' AND value IS NOT NULL AND value<>'*'", _FILLED),
    "r17_compare": " UNION ALL ".join(_select(_overview("status", v) | {"counts": _counts("keys WHERE key='status'" if v is None else "plain_tags WHERE key='status' AND value='O'", False)}, "key", "value", "counts", "projects", "has_map", "wiki_pages", "description") for v in (None, "O")),
    "r18_page_facts": """SELECT 'brand' AS key, NULL::VARCHAR AS value, description, i.image, CASE WHEN width <= 330 THEN image_url ELSE thumb_url_prefix || '330' || thumb_url_suffix END AS image_url,
      (SELECT count(DISTINCT project_id) FROM project_tags WHERE key='brand') AS projects, (SELECT coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') FROM discardable WHERE key='brand') AS discardable_by, n AS wiki_pages FROM
      (SELECT arg_min(description, (lang<>'de')::VARCHAR || title) FILTER (WHERE description<>'' AND lang IN ('de','en')) AS description, arg_min(image, (lang<>'de')::VARCHAR || title) FILTER (WHERE image<>'' AND lang IN ('de','en')) AS image, count(*) AS n
       FROM wikipages WHERE key='brand' AND value IS NULL) LEFT JOIN wiki_images i USING (image)""",
    "r25_role_treemap": """SELECT role, type, CASE type WHEN 'nodes' THEN n WHEN 'ways' THEN w ELSE r END AS count FROM (SELECT CASE WHEN count_all >= members_all * 0.2 THEN role END AS role, sum(count_nodes)::BIGINT AS n, sum(count_ways)::BIGINT AS w, sum(count_relations)::BIGINT AS r
      FROM relation_roles JOIN relation_types USING (rtype) WHERE rtype='BUILDING' GROUP BY 1), (VALUES ('nodes'), ('ways'), ('relations')) v(type)""",
}


def with_tables(sql: str, more: dict[str, str] | None = None) -> str:
    """The query behind the tables that it needs, each before those that use it."""
    tables = TABLES | (more or {})
    needed: dict[str, bool] = {}

    def need(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN|,)\s+([a-z_0-9]+)", text):
            if name in tables and name not in needed:
                needed[name] = True
                need(tables[name])
                needed[name] = needed.pop(name)  # behind what it uses

    need(sql)
    return "WITH " + ",\n".join(f"{n} AS ({tables[n]})" for n in needed) + "\n" + sql if needed else sql


ORACLE_SQL = {name: with_tables(sql) for name, sql in SQL.items()}
