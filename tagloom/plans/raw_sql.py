"""DuckDB SQL for the queries over raw inputs: what their jobs have to find, from the numbers that the inputs are made of."""

from __future__ import annotations

from .registered_sql import OBJECT_STATS, SQL, _list_text, _union, with_tables

_W = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]+', '', 'g'), ' ')"

TABLES = {
    "raw": f"""SELECT *, CASE WHEN i % 17 = 0 THEN 'redirect' ELSE 'page' END AS type, CASE WHEN i % 17 = 0 THEN 'moved' WHEN i % 13 = 0 THEN 'plain' WHEN i % 19 = 0 THEN 'bad' ELSE 'page' END AS b,
      CASE WHEN kind < 3 OR odd = 0 THEN CASE dl WHEN 'en' THEN '' ELSE upper(dl) || ':' END WHEN odd IN (1, 2) THEN 'DE:' WHEN odd = 3 THEN 'en:' WHEN odd = 4 THEN '' ELSE 'Bad code:' END AS prefix,
      CASE kind WHEN 0 THEN 'Key:' WHEN 1 THEN 'Tag:' WHEN 2 THEN 'Relation:' ELSE CASE WHEN odd IN (2, 4) THEN 'Tag:' ELSE 'Key:' END END AS head,
      CASE kind WHEN 0 THEN 'key' || i WHEN 1 THEN 'key' || i % 50 WHEN 3 THEN CASE odd WHEN 0 THEN 'a/b' || i ELSE 'k' || i END END AS key,
      CASE WHEN kind = 1 THEN 'val' || i WHEN kind = 3 AND odd = 1 THEN 'v' WHEN kind = 3 AND odd = 4 THEN 'v/w' END AS value, CASE kind WHEN 2 THEN 'rel' || i END AS rtype
      FROM (SELECT doc_id AS i, coalesce(lang, 'en') AS dl, {_W} AS w, doc_id % 4 AS kind, doc_id // 4 % 6 AS odd FROM documents)""",
    "pages": """SELECT *, prefix || head || coalesce(rtype, key || coalesce('=' || value, '')) AS title, CASE prefix WHEN '' THEN 'en' ELSE lower(regexp_replace(prefix, ':$', '')) END AS lang,
      CASE WHEN rtype IS NULL THEN key || coalesce('=' || value, '') END AS tag, CASE WHEN rtype IS NULL AND prefix <> '' THEN lower(substr(head, 1, 3)) END AS ttype FROM raw""",
    "bodies": """SELECT *, CASE b WHEN 'moved' THEN CASE WHEN i % 34 = 0 THEN '#REDIRECT [[Tag:target=x' || i || ']]' ELSE '#REDIRECT to nothing' END WHEN 'plain' THEN w WHEN 'bad' THEN 'x }} ' || w ELSE
      '<!-- {{Key|no}} -->{{' || ['KeyDescription', 'ValueDescription', 'RelationDescription', 'KeyDescription'][kind + 1] || CASE WHEN i % 10 = 2 THEN '|stray' ELSE '' END || '|description=' || w || CASE WHEN i % 12 = 5 THEN ' <b>' ELSE '' END || ' {{Tag|key' || i % 50 || '|val' || i % 7 || '}}'
      || CASE i % 3 WHEN 0 THEN '|image=File:i' || i % 40 || '.png' WHEN 1 THEN '|image=no image' ELSE '' END || CASE i % 7 WHEN 2 THEN '|osmcarto-rendering=Image:r' || i % 5 || '.svg' WHEN 3 THEN '|osmcarto-rendering=none' ELSE '' END
      || '|onNode=' || ['yes', 'no'][i % 2 + 1] || CASE WHEN i % 15 = 4 THEN '|onNode=no' ELSE '' END || '|onWay=' || CASE WHEN i % 5 = 0 THEN 'maybe' ELSE 'yes' END
      || CASE WHEN odd < 2 THEN '|onArea=yes' WHEN odd < 4 THEN '|onArea=no' ELSE '' END || '|onRelation=' || CASE odd WHEN 5 THEN 'Yes' WHEN 1 THEN 'yes' ELSE 'no' END
      || CASE WHEN i % 9 <> 8 THEN '|status=' || ['approved', 'de facto', 'proposed'][i % 3 + 1] ELSE '' END || CASE WHEN i % 5 = 1 THEN '|statuslink=Proposal ' || i % 3 ELSE '' END || '|group=g' || i % 9
      || CASE WHEN i % 6 < 2 THEN '|implies={{Tag|i' || i % 3 || '|v}} {{Key|j}}' ELSE '' END || '|combination={{Tag|c' || i % 4 || '}} {{Tag|d|e' || i % 4 || '}}}} ' || w || ' {{Tag|link' || i % 6 || '|x}} [[other]]'
      || CASE WHEN i % 11 <> 10 THEN '{{RelatedTerm|' || CASE WHEN i % 3 = 0 THEN '' WHEN i % 3 = 1 THEN 'de|' WHEN i % 21 = 2 THEN 'b@d|' ELSE 'fr|' END || 'term' || i % 11 || '}}' ELSE '' END
      || ' {{Wikipedia|' || CASE i % 10 WHEN 0 THEN 'b@d' WHEN 1 THEN '' WHEN 2 THEN 'commons' WHEN 3 THEN 'de' ELSE 'en' END || CASE WHEN i % 10 <> 4 THEN '|Article ' || i % 8 ELSE '' END || '}}' END AS body FROM pages""",
    "good": "SELECT * FROM pages WHERE kind < 3",
    "described": "SELECT * FROM good WHERE b = 'page'",
    "wiki_links": """SELECT CASE i % 6 WHEN 0 THEN 'Tag:key' || i % 10 || '=v' WHEN 1 THEN 'DE:Key:key' || i % 10 WHEN 2 THEN 'Category:c' || i WHEN 3 THEN 'User talk:u' || i WHEN 4 THEN 'Proposed_features/p' || i ELSE 'Relation:r' || i % 10 END AS from_title,
      CASE i % 2 WHEN 0 THEN 'Key:key' || i % 10 ELSE 'Tag:key' || i % 10 || '=v' END AS to_title, i FROM (SELECT doc_id AS i FROM documents)""",
    "cache": "SELECT p_partkey AS n, 'File:p' || p_partkey % 500 || '.png' AS title, (DATE '2024-04-01' - (p_partkey % 120)::INT)::TIMESTAMP AS timestamp, p_partkey % 120 AS age FROM part",
    "rewritings": """SELECT DISTINCT f, t FROM (SELECT 'file:p' || n % 500 || '.png' AS f, title AS t FROM cache
      UNION ALL SELECT title, 'File:p' || CASE WHEN n % 500 % 50 = 8 THEN n % 500 - 1 ELSE n % 500 + 1 END || '.png' FROM cache WHERE n % 500 % 10 = 3 OR n % 500 % 50 IN (7, 8))""",
    "canonical": """SELECT a.f, coalesce(b.t, a.t) AS t FROM rewritings a LEFT JOIN rewritings b ON a.t = b.f WHERE coalesce(b.t, a.t) NOT IN (SELECT f FROM rewritings)""",
    "newest": "SELECT *, row_number() OVER (ORDER BY age <= 30, timestamp, title) AS r FROM (SELECT * FROM cache QUALIFY row_number() OVER (PARTITION BY title ORDER BY timestamp DESC) = 1) WHERE age <= 90",
    "fetches": """SELECT s_suppkey AS k, s_name AS id, TIMESTAMP '2024-01-01' AS fetch_date, CASE WHEN s_suppkey % 4 = 0 THEN '404' ELSE '200' END AS fetch_status FROM supplier
      UNION ALL SELECT s_suppkey, s_name, TIMESTAMP '2024-01-05', CASE WHEN s_suppkey % 10 = 0 THEN '404' ELSE '200' END FROM supplier""",
    "subtags": """SELECT * FROM (SELECT ['language', 'script', 'region', 'variant'][k % 4 + 1] AS stype, CASE WHEN k % 4 = 0 THEN lower(substr(n, 1, 2)) WHEN k % 8 = 1 THEN 'Zxxx' WHEN k % 4 = 1 THEN upper(substr(n, 1, 1)) || lower(substr(n, 2, 3)) WHEN k % 8 = 2 THEN '001'
      WHEN k % 4 = 2 THEN upper(substr(n, 1, 2)) ELSE lower(n) END AS subtag, '2005-10-16' AS added, CASE WHEN k % 8 = 0 THEN 'Latn' END AS suppress_script, CASE WHEN k % 12 = 8 THEN 'special' END AS scope,
      CASE k WHEN 4 THEN 'Private use' ELSE n || ' in region ' || r END || CASE WHEN k % 3 = 0 THEN '. Second ' || n ELSE '' END AS description, CASE WHEN k % 4 = 3 THEN 'aa,bb' END AS prefix
      FROM (SELECT n_name AS n, n_nationkey AS k, n_regionkey AS r FROM nation)) WHERE description <> 'Private use' AND coalesce(scope, '') <> 'special' AND subtag NOT IN ('Zxxx', '001')""",
    "sites": "SELECT lower(substr(n_name, 1, 2)) || chr(97 + n_nationkey) AS prefix, n_name || ' & <others>' AS language FROM nation WHERE n_nationkey % 2 = 0",
    "chars": "SELECT n_name, u.i - 1 AS num, substr(n_name, u.i::INT, 1) AS char, unicode(substr(n_name, u.i::INT, 1))::BIGINT AS codepoint FROM nation, LATERAL (SELECT unnest(range(1, length(n_name) + 1)) AS i) u",
    "unicode_data": "SELECT DISTINCT codepoint, CASE WHEN codepoint BETWEEN 65 AND 94 THEN 'S00' || (codepoint - 65) // 6 ELSE 'Zzzz' END AS script, CASE char WHEN ' ' THEN 'Zs' ELSE 'Lu' END AS category, 'NAME OF ' || char AS name FROM chars",
    "items": "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN 'http://elsewhere.example/' ELSE 'http://www.wikidata.org/entity/' END || ['Q', 'P'][s_suppkey % 2 + 1] || s_suppkey AS item, CASE WHEN s_suppkey % 7 <> 0 THEN ['Q', 'P'][s_suppkey % 2 + 1] || s_suppkey END AS code, 'about ' || s_name AS description, 'key' || s_suppkey % 20 AS prop FROM supplier",
    "item_tags": "SELECT *, CASE WHEN k % 11 = 0 THEN prop WHEN k % 13 = 0 THEN 'a=b=' || k ELSE prop || '=val' || k END AS tag, code IS NOT NULL AND k % 11 <> 0 AND k % 13 <> 0 AS good FROM items",
    "item_errors": "SELECT 'P13786' AS wikidata, item, code, prop AS propvalue, description, 'Item has invalid format' AS error FROM items WHERE code IS NULL UNION ALL SELECT 'P1282', item, code, tag, description, 'Item has invalid format' FROM item_tags WHERE NOT good",
    "source_rows": "SELECT lower(r_name) AS id, r_name AS name, max(o_orderdate)::TIMESTAMP AS data_until, max(o_orderdate)::TIMESTAMP AS update_start, max(o_orderdate)::TIMESTAMP AS update_end, r_regionkey % 2 = 0 AS visible, r_regionkey + 1 AS no FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY ALL",
    "name_keys": """SELECT p, kind, lower(substr(n_name, 1, 2)) AS code, count(*) AS n FROM (SELECT c_custkey // 5 % 4 AS p, c_custkey % 5 AS kind, n_name FROM customer JOIN nation ON c_nationkey=n_nationkey) GROUP BY ALL""",
    "link_tags": """SELECT k, ['addr:country', 'image', 'phone', 'ref:bag', 'species', 'url', 'website', 'wikidata', 'wikipedia', 'other'][k % 10 + 1] AS key, CASE WHEN k % 10 = 0 THEN CASE WHEN k % 20 = 0 THEN 'DE' ELSE 'Germany' END WHEN k % 10 IN (1, 5, 6) THEN CASE WHEN k % 4 = 1 THEN 'ftp://x/' || k ELSE 'https://x.example/' || k END
      WHEN k % 10 = 2 THEN '+49 (30) ' || k WHEN k % 10 = 3 THEN k::VARCHAR WHEN k % 10 = 4 THEN array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(p_name, ' ')], ' ') WHEN k % 10 = 7 THEN 'Q' || k ELSE CASE WHEN k % 20 = 8 THEN 'naa' ELSE 'xx' END || ':Title ' || k END AS value
      FROM (SELECT p_partkey AS k, p_name FROM part)""",
}

_T = "'2024-01-02T00:00:00Z'"
_LOG = """concat_ws(chr(10), CASE WHEN k % 6 = 5 THEN 'ERROR: data_updated is not yyyymmddThhmmssZ and is ignored' END, CASE WHEN k % 2 = 1 THEN 'WARNING: project_url is not an https URL: http://x.example/' || k END, CASE WHEN k % 3 = 1 THEN 'WARNING: icon_url is not an https URL: http://icon.example/' || k END,
  CASE WHEN k % 9 = 8 THEN 'WARNING: unknown property: more' END, CASE WHEN k % 7 = 6 THEN 'WARNING: project has unknown property: colour' END, 'ERROR: tags.2.object_types has an unknown type: house', 'ERROR: tags.3.value is not a string',
  'ERROR: tags.4.key is missing', 'WARNING: tags.5.object_types is empty and means all types', 'ERROR: tags.6.key is not a string')"""
_ABOUT = "title, lang, key, value"
_WHERE = "'Template:Key/Value/RelationDescription'"
_DESCRIPTION = "trim(w || CASE WHEN i % 12 = 5 THEN ' <b>' ELSE '' END || ' key' || i % 50 || '=val' || i % 7)"
_LABELS = "LEFT JOIN (SELECT code, 'label of ' || description AS label FROM items WHERE code IS NOT NULL AND k % 3 = 0) l USING (code)"
_VALID = "SELECT s_suppkey AS k, s_name AS id FROM supplier WHERE s_suppkey % 10 > 4"

RAW_SQL = {
    "a1_read_objects": """SELECT 'n' AS otype, count(*) AS n, sum(o_orderkey)::BIGINT AS oids, sum(o_custkey)::BIGINT AS uids, sum(3 + (o_orderpriority='1-URGENT')::INT)::BIGINT AS tags, 0::BIGINT AS nds, 0::BIGINT AS members, sum((o_custkey * 7919 + o_orderkey * 31) % 36000 - 18000)::BIGINT AS lon, count(*) AS visible FROM orders
      UNION ALL SELECT 'w', count(*), sum(p_partkey)::BIGINT, sum(p_size)::BIGINT, 4 * count(*), sum(2 + (p_size % 2 = 0)::INT)::BIGINT, 0, NULL, count(*) FROM part
      UNION ALL SELECT 'r', count(*), sum(c_custkey)::BIGINT, sum(c_nationkey)::BIGINT, 2 * count(*), 0, (SELECT count(*) FROM orders JOIN customer ON o_custkey=c_custkey), NULL, count(*) FROM customer""",
    "a2_read_history": "SELECT otype, count(*) AS n, sum(version)::BIGINT AS versions, count(*) FILTER (WHERE visible) AS visible, min(ts) AS first, max(ts) AS last FROM history GROUP BY otype",
    "a3_page_list": f"SELECT type, {_T} AS timestamp, '0' AS namespace, title FROM pages",
    "a4_current_bodies": f"SELECT title, type, {_T} AS timestamp, '0' AS namespace, body FROM bodies WHERE i % 23 <> 0",
    "a4_listed_bodies": "SELECT title, '2023-01-01T00:00:00Z' AS timestamp, 'old' AS body FROM bodies UNION ALL SELECT title, '2024-01-03T00:00:00Z', body FROM bodies WHERE i % 23 <> 0",
    "a5_load_projects": "SELECT id, CASE fetch_status WHEN '200' THEN 'OK' ELSE 'FETCH ERROR' END AS status, fetch_status, CASE WHEN k % 2 = 0 THEN fetch_date ELSE TIMESTAMP '2023-12-31' END AS data_updated FROM fetches WHERE fetch_date = TIMESTAMP '2024-01-05'",
    "a6_prune_fetch_log": """SELECT id, fetch_date, fetch_status FROM fetches f WHERE k % 3 <> 0 AND fetch_date >= coalesce((SELECT max(fetch_date) FROM fetches g WHERE g.k=f.k AND fetch_status='200'), fetch_date)
      AND (fetch_status='200' OR fetch_date + INTERVAL 7 DAY >= TIMESTAMP '2024-01-10')""",
    "a7_read_subtags": "SELECT * FROM subtags",
    "a8_unicode_scripts": "SELECT 'S00' || r_regionkey AS script, 'Script' || r_regionkey AS name FROM region",
    "a9_script_ranges": "SELECT (65 + 6 * r_regionkey)::BIGINT AS codepoint_from, (70 + 6 * r_regionkey)::BIGINT AS codepoint_to, 'S00' || r_regionkey AS script, 'Lu' AS category FROM region",
    "a10_unicode_data": "SELECT * FROM unicode_data",
    "a11_wikipedia_sites": "SELECT * FROM sites",
    "a13_editor_lists": "SELECT 'old' || n_nationkey % 7 AS old_key, CASE WHEN n_nationkey % 3 = 0 THEN '*' ELSE lower(n_name) END AS old_value, lower(n_name) AS new_value FROM nation",
    "a12_key_bindings": "SELECT item, prop, description, NULL::VARCHAR AS label, NULL::VARCHAR AS lang FROM items",
    "a12_label_bindings": "SELECT item, NULL::VARCHAR AS prop, NULL::VARCHAR AS description, 'label of ' || description AS label, ['en', 'de', 'pt-br'][k % 3 + 1] AS lang FROM items",
    "a13_discarded_keys": "SELECT 'id' AS source, lower(r_name) AS key FROM region",
    "a16_read_links": "SELECT from_title, to_title FROM wiki_links",
    "a17_languages": "SELECT DISTINCT lang AS code, lang AS iso639_1, 'language, ' || lang AS english_name, upper(lang) AS native_name FROM documents WHERE lang IS NOT NULL",
    "a18_catalog": "SELECT rtype AS name, count(*) AS n, sum(count_all)::BIGINT AS count_all FROM relation_roles GROUP BY rtype UNION ALL SELECT characters, count(*), sum(count_all)::BIGINT FROM plain_keys GROUP BY characters",
    "z2_write_csv": "SELECT key, value, count_all FROM plain_tags",
    "z3_result_envelope": f"SELECT '/roles' AS url, NULL::VARCHAR AS data_until, 1 AS page, 2 AS rp, (SELECT count(*) FROM prevalent_roles WHERE rtype='BUILDING') AS total, {_list_text('role || chr(58) || count')} AS data FROM (SELECT * FROM prevalent_roles WHERE rtype='BUILDING' ORDER BY role LIMIT 2)",
    "z4_append_history": f"SELECT key, value * f AS value, udate FROM ({OBJECT_STATS}), (VALUES (1, DATE '2024-01-01'), (2, DATE '2024-01-02')) d(f, udate)",
    "z5_metrics": " UNION ALL ".join(
        ["SELECT 'table_rows' AS metric, 'keys' AS label, count(*)::DOUBLE AS value FROM plain_keys UNION ALL SELECT 'table_rows', 'tags', count(*) FROM plain_tags"]
        + [f"SELECT 'source_{c}', id, epoch({c}) FROM source_rows" for c in ("update_start", "update_end", "data_until")]
        + [f"SELECT 'image_age_bucket', '{d}', count(*) FROM cache WHERE age <= {d}" for d in range(10, 101, 10)]
        + ["SELECT 'image_age_bucket', '+Inf', count(*) FROM cache UNION ALL SELECT 'image_age_count', '', count(*) FROM cache UNION ALL SELECT 'image_age_sum', '', sum(age) FROM cache"]
        + ["SELECT 'image_repository', ['local', 'shared'][n % 2 + 1], count(*) FROM cache GROUP BY 2"]
    ),
    "b20_key_characters": "SELECT n_name AS key, num::INT AS num, char, codepoint, script, category, name FROM chars JOIN unicode_data USING (codepoint)",
    "d1_parse_titles": "SELECT title, lang, tag, CASE WHEN rtype IS NULL THEN key END AS key, CASE WHEN rtype IS NULL THEN value END AS value, ttype, rtype FROM pages",
    "d2_good_titles": "SELECT title FROM good",
    "d2_title_problems": f"SELECT 'page title' AS location, ['slash_in_key', 'value_in_key_page', 'no_value_for_tag_page', 'lang_is_en', 'slash_in_value', 'wrong_lang_format'][odd + 1] AS reason, {_ABOUT}, NULL::VARCHAR AS info FROM pages WHERE kind = 3",
    "d3_redirects": "SELECT title AS from_title, lang AS from_lang, key AS from_key, value AS from_value, 'Tag:target=x' || i AS to_title, CASE WHEN kind < 2 THEN 'en' END AS to_lang, CASE WHEN kind < 2 THEN 'target' END AS to_key, CASE WHEN kind < 2 THEN 'x' || i END AS to_value FROM good WHERE i % 34 = 0",
    "d4_templates": """SELECT title, b <> 'bad' AS parsed, CASE b WHEN 'page' THEN concat_ws(' ', 'tag(key' || i % 50 || ';val' || i % 7 || ')', CASE WHEN i % 6 < 2 THEN 'tag(i' || i % 3 || ';v) key(j)' END, 'tag(c' || i % 4 || ')', 'tag(d;e' || i % 4 || ')',
      ['key', 'value', 'relation', 'key'][kind + 1] || 'description(' || CASE WHEN i % 10 = 2 THEN 'stray' ELSE '' END || ')', 'tag(link' || i % 6 || ';x)',
      CASE WHEN i % 11 <> 10 THEN 'relatedterm(' || CASE WHEN i % 3 = 0 THEN '' WHEN i % 3 = 1 THEN 'de;' WHEN i % 21 = 2 THEN 'b@d;' ELSE 'fr;' END || 'term' || i % 11 || ')' END,
      'wikipedia(' || CASE i % 10 WHEN 0 THEN 'b@d' WHEN 1 THEN '' WHEN 2 THEN 'commons' WHEN 3 THEN 'de' ELSE 'en' END || CASE WHEN i % 10 <> 4 THEN ';Article ' || i % 8 ELSE '' END || ')') ELSE '' END AS templates FROM pages""",
    "d5_descriptions": f"SELECT title, CASE b WHEN 'page' THEN {_DESCRIPTION} END AS description, CASE WHEN b <> 'moved' THEN b = 'page' END AS has_templ, CASE WHEN b <> 'moved' THEN b <> 'bad' END AS parsed, CASE b WHEN 'moved' THEN 'r' WHEN 'page' THEN 't' ELSE 'p' END AS status FROM good",
    "d6_images": """SELECT title, CASE WHEN b = 'page' THEN CASE i % 3 WHEN 0 THEN 'File:i' || i % 40 || '.png' WHEN 1 THEN '' END END AS image,
      CASE WHEN b = 'page' THEN CASE i % 7 WHEN 2 THEN 'File:r' || i % 5 || '.svg' WHEN 3 THEN '' END END AS rendering FROM good""",
    "d7_object_types": """SELECT title, CASE WHEN b <> 'moved' THEN b = 'page' AND i % 2 = 0 AND i % 15 <> 4 END AS on_node, CASE WHEN b <> 'moved' THEN b = 'page' AND i % 5 <> 0 END AS on_way,
      CASE WHEN b <> 'moved' THEN b = 'page' AND odd < 2 END AS on_area, CASE WHEN b <> 'moved' THEN b = 'page' AND odd = 1 END AS on_relation FROM good""",
    "d8_tag_lists": """SELECT title, CASE WHEN b <> 'moved' THEN CASE WHEN b = 'page' AND i % 6 < 2 THEN 'i' || i % 3 || '=v,j' ELSE '' END END AS tags_implies, CASE b WHEN 'page' THEN 'c' || i % 4 || ',d=e' || i % 4 WHEN 'moved' THEN NULL ELSE '' END AS tags_combination,
      CASE b WHEN 'page' THEN 'c' || i % 4 || ',d=e' || i % 4 || CASE WHEN i % 6 < 2 THEN ',i' || i % 3 || '=v,j' ELSE '' END || ',key' || i % 50 || '=val' || i % 7 || ',link' || i % 6 || '=x' WHEN 'moved' THEN NULL ELSE '' END AS tags_linked FROM good""",
    "d9_related_terms": "SELECT key, value, rtype, CASE i % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS lang, 'term' || i % 11 AS term FROM described WHERE i % 11 <> 10 AND i % 21 <> 2",
    "d10_wikipedia_links": "SELECT key, value, rtype, CASE i % 10 WHEN 2 THEN 'commons' WHEN 3 THEN 'de' ELSE 'en' END AS lang, CASE WHEN i % 10 <> 4 THEN 'Article ' || i % 8 END AS link FROM described WHERE i % 10 <> 0",
    "d11_group_status": "SELECT title, CASE b WHEN 'page' THEN 'g' || i % 9 END AS tgroup, CASE WHEN b = 'page' AND i % 9 <> 8 THEN ['approved', 'de facto', 'proposed'][i % 3 + 1] END AS approval_status, CASE WHEN b = 'page' AND i % 5 = 1 THEN 'Proposal ' || i % 3 END AS statuslink FROM good",
    "d12_problems": f"""SELECT {_WHERE} AS location, 'invalid image parameter' AS reason, {_ABOUT}, 'no image' AS info FROM described WHERE i % 3 = 1
      UNION ALL SELECT {_WHERE}, 'non-file osmcarto-rendering parameter', {_ABOUT}, 'none' FROM described WHERE i % 7 = 3
      UNION ALL SELECT {_WHERE}, 'description parameter contains characters that might be problematic', {_ABOUT}, {_DESCRIPTION} FROM described WHERE i % 12 = 5
      UNION ALL SELECT {_WHERE}, 'multiple values for onNode parameter', {_ABOUT}, ['yes', 'no'][i % 2 + 1] || ', no' FROM described WHERE i % 15 = 4
      UNION ALL SELECT {_WHERE}, 'invalid value for onWay parameter', {_ABOUT}, 'maybe' FROM described WHERE i % 5 = 0
      UNION ALL SELECT {_WHERE}, 'invalid value for onRelation parameter', {_ABOUT}, 'Yes' FROM described WHERE odd = 5
      UNION ALL SELECT {_WHERE}, 'has positional parameter', {_ABOUT}, 'stray' FROM described WHERE i % 10 = 2
      UNION ALL SELECT 'Template:RelatedTerm', 'invalid lang parameter', {_ABOUT}, 'b@d' FROM described WHERE i % 21 = 2 AND i % 11 <> 10
      UNION ALL SELECT 'Template:Wikipedia', 'invalid lang parameter', {_ABOUT}, 'b@d' FROM described WHERE i % 10 = 0
      UNION ALL SELECT 'page content', 'parsing failed', {_ABOUT}, NULL FROM good WHERE b = 'bad' UNION ALL SELECT 'redirect page content', 'parsing failed', {_ABOUT}, NULL FROM good WHERE b = 'moved' AND i % 34 <> 0""",
    "d20_canonical_titles": "SELECT f AS from_title, t AS to_title FROM canonical",
    "d20_rewritten_images": """SELECT p.title, i.title AS image, 'https://i.example/' || i.m || '.png' AS image_url FROM (SELECT DISTINCT title, n % 500 AS m FROM cache WHERE n % 9 <> 0) i
      JOIN (SELECT title, coalesce(t, image) AS image FROM (SELECT 'Key:k' || doc_id AS title, ['file', 'File'][doc_id % 3 + 1] || ':p' || doc_id % 500 || '.png' AS image FROM documents WHERE doc_id % 3 < 2) LEFT JOIN canonical ON image = f) p ON p.image = i.title""",
    "d21_expire_cache": "SELECT title, timestamp FROM newest WHERE age <= 30 OR r > 5",
    "d23_classify_links": """SELECT from_title, to_title, CASE i % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 5 THEN 'en' END AS from_lang, CASE i % 6 WHEN 0 THEN 'tag' WHEN 1 THEN 'key' WHEN 5 THEN 'relation' END AS from_type,
      CASE i % 6 WHEN 0 THEN 'key' || i % 10 || '=v' WHEN 1 THEN 'key' || i % 10 WHEN 5 THEN 'r' || i % 10 END AS from_name, 'en' AS to_lang, ['key', 'tag'][i % 2 + 1] AS to_type, 'key' || i % 10 || ['', '=v'][i % 2 + 1] AS to_name,
      ['tag_to_key', 'key_to_tag', 'category', 'rest', 'proposed', 'ktr'][i % 6 + 1] AS link_class FROM wiki_links""",
    "e1_validate_projects": f"""SELECT id, CASE WHEN k % 10 = 1 THEN 'JSON_ERROR' WHEN k % 10 < 5 THEN 'PARSE_ERROR' ELSE 'OK' END AS status, CASE k % 10 WHEN 1 THEN 'FATAL: not JSON' WHEN 2 THEN 'FATAL: top level is not an object' WHEN 3 THEN 'FATAL: data_format is missing or unknown (known: 1)'
      WHEN 4 THEN concat_ws(chr(10), 'FATAL: project.description is missing or not a string', 'FATAL: project.project_url is missing or not a string', 'ERROR: project.contact_name is missing or not a string', 'ERROR: project.contact_email is missing or not a string') ELSE {_LOG} END AS error_log,
      CASE WHEN k % 10 > 4 AND k % 6 <> 5 THEN '20240101T000000Z' END AS data_updated, CASE WHEN k % 10 > 4 THEN 'P' || k WHEN k % 10 = 4 THEN 'x' END AS name, CASE WHEN k % 10 > 4 THEN 'd' END AS description, CASE WHEN k % 10 > 4 THEN 'http' || CASE WHEN k % 2 = 0 THEN 's' ELSE '' END || '://x.example/' || k END AS project_url,
      CASE WHEN k % 10 > 4 THEN 'c' END AS contact_name, CASE WHEN k % 10 > 4 THEN 'e' END AS contact_email, CASE WHEN k % 10 > 4 AND k % 4 = 1 THEN 'https://doc.example/' || k END AS doc_url, CASE WHEN k % 10 > 4 AND k % 3 = 1 THEN 'http://icon.example/' || k END AS icon_url FROM (SELECT s_suppkey AS k, s_name AS id FROM supplier WHERE s_suppkey % 10 <> 0)""",
    "e2_project_tags": f"""SELECT id AS project_id, key, CASE key WHEN 'brand' THEN 'Brand#' || k % 5 END AS value, key <> 'brand' OR k % 2 = 0 AS on_node, key <> 'brand' OR k % 2 = 0 AS on_way, key <> 'brand' AS on_relation, key <> 'brand' OR k % 2 = 1 AS on_area,
      CASE WHEN key = 'brand' AND k % 2 = 0 THEN 'about ' || k END AS description, CASE WHEN key = 'brand' AND k % 3 = 0 THEN 'https://doc.example/b' END AS doc_url, CASE WHEN key = 'brand' AND k % 3 = 0 THEN 'https://icon.example/b' END AS icon_url
      FROM (SELECT k, id, unnest(['brand', 'k' || k, 'e']) AS key FROM ({_VALID}))""",
    "f1_language_stats": "SELECT 'subtag_' || stype AS key, count(*) AS value FROM subtags GROUP BY stype UNION ALL SELECT 'wikipedia_sites', count(*) FROM sites",
    "g1_deprecated_tags": "SELECT DISTINCT 'old' || n_nationkey % 7 AS key, CASE WHEN n_nationkey % 3 <> 0 THEN lower(n_name) END AS value FROM nation",
    "h1_wikidata_keys": "SELECT code, prop AS key FROM items WHERE code IS NOT NULL",
    "h1_wikidata_tags": "SELECT code, prop AS key, 'val' || k AS value FROM item_tags WHERE good",
    "h1_wikidata_labels": "SELECT code, 'label of ' || description AS label, ['en', 'de', 'pt-br'][k % 3 + 1] AS lang FROM items WHERE code IS NOT NULL",
    "h2_wikidata_stats": " UNION ALL ".join(
        [
            _union({"wikidata_keys": "count(*)", "wikidata_distinct_keys": "count(DISTINCT prop)"} | {f"wikidata_keys_{c.lower()}code": f"count(*) FILTER (WHERE code LIKE '{c}%')" for c in "PQ"}, "items WHERE code IS NOT NULL"),
            _union({"wikidata_tags": "count(*)", "wikidata_distinct_tags": "count(DISTINCT tag)"} | {f"wikidata_tags_{c.lower()}code": f"count(*) FILTER (WHERE code LIKE '{c}%')" for c in "PQ"}, "item_tags WHERE good"),
            _union({"wikidata_labels": "count(code)"}, "items"),
            _union({"wikidata_errors": "count(*)"}, "item_errors"),
        ]
    ),
    "m1_sources": "SELECT * FROM source_rows",
    "q40_languages": """SELECT upper(substr(stype, 1, 1)) || substr(stype, 2) AS type, subtag, description, added, concat_ws(', ', 'Scope: ' || scope, 'Default script: ' || suppress_script, 'Prefixes: ' || prefix) AS notes FROM subtags WHERE lower(subtag) LIKE '%a%' OR lower(description) LIKE '%a%'""",
    "q41_characters": "SELECT n_name, num::INT AS num, char, codepoint, script, 'Script' || substr(script, 4) AS script_name, category, name FROM chars JOIN unicode_data USING (codepoint) WHERE script <> 'Zzzz'",
    "q48_wikidata_keys": f"SELECT substr(code, 1, 1) AS type, code, prop AS key, label FROM items {_LABELS} WHERE code IS NOT NULL",
    "q49_wikidata_tags": f"SELECT substr(code, 1, 1) AS type, code, prop AS key, 'val' || k AS value, label FROM item_tags {_LABELS} WHERE good AND 'val' || k LIKE '%val1%'",
    "q50_wikidata_errors": "SELECT * FROM item_errors",
    "q51_site_sources": "SELECT * FROM source_rows WHERE visible",
    "q52_keys_name": """SELECT ['name', 'old_name', 'addr:name'][p + 1] || CASE WHEN kind = 0 THEN '' ELSE ':' || langtag END AS key, n AS count_all, CASE p WHEN 2 THEN 'addr' END AS prefix, CASE p WHEN 1 THEN 'old_name' ELSE 'name' END AS type, langtag, lang,
      CASE WHEN lang IS NULL THEN NULL WHEN length(lang) NOT BETWEEN 2 AND 3 THEN 'bad' WHEN lang_note IS NOT NULL THEN 'good' ELSE 'okay' END AS lang_state, lang_note, CASE kind WHEN 2 THEN 'Latn' END AS script,
      CASE kind WHEN 2 THEN CASE WHEN script_note IS NULL THEN 'okay' ELSE 'good' END END AS script_state, script_note, NULL::VARCHAR AS region
      FROM (SELECT p, kind, CASE kind WHEN 1 THEN code WHEN 2 THEN code || '-Latn' WHEN 3 THEN code || '-Ca-US' WHEN 4 THEN 'x-y-z' END AS langtag, CASE WHEN kind IN (1, 2, 3) THEN code WHEN kind = 4 THEN 'x' END AS lang, sum(n)::BIGINT AS n FROM name_keys WHERE p < 3 GROUP BY ALL)
      LEFT JOIN (SELECT subtag AS lang, max(description) AS lang_note FROM subtags WHERE stype = 'language' GROUP BY subtag) USING (lang)
      LEFT JOIN (SELECT 2 AS kind, max(description) AS script_note FROM subtags WHERE stype = 'script' AND subtag = 'Latn') USING (kind)""",
    "r12_image_comparison": "SELECT key, lang, image, image_url FROM wikipages JOIN wiki_images USING (image) WHERE value IS NULL",
    "r19_tag_links": """SELECT key, value, links FROM (SELECT *, CASE k % 10 WHEN 0 THEN CASE value WHEN 'DE' THEN 'Country DE:https://en.wikipedia.org/wiki/DE,ISO 3166-2:https://en.wikipedia.org/wiki/ISO_3166-2:DE' END
      WHEN 2 THEN '+49-30-' || k || ':tel:+49-30-' || k WHEN 3 THEN lpad(value, 16, '0') || ':https://bagviewer.kadaster.nl/lvbag/bag-viewer/?objectId=' || lpad(value, 16, '0') WHEN 4 THEN value || ':https://species.wikimedia.org/wiki/' || value
      WHEN 7 THEN value || ':https://www.wikidata.org/wiki/' || value WHEN 8 THEN CASE WHEN k % 20 = 8 THEN 'Title ' || k || ':https://naa.wikipedia.org/wiki/Title ' || k END
      WHEN 9 THEN NULL ELSE CASE WHEN k % 4 <> 1 THEN value || ':' || value END END AS links FROM link_tags) WHERE links IS NOT NULL""",
    "r21_freshness": "SELECT min(data_until) AS data_until, min(data_until) < TIMESTAMP '2024-05-30 12:00:00' AS outdated FROM source_rows WHERE visible",
    "r23_stats_dump": SQL["m2_master_stats"],
    "r24_link_key_usage": "SELECT key, count(*) AS count_all, count(DISTINCT value) AS values_all FROM link_tags WHERE key <> 'other' GROUP BY key",
}
_IMAGE = """SELECT title AS image, (n % 90 + 10)::BIGINT AS width, (n % 70 + 5)::BIGINT AS height, n * 1000 AS size, 'image/png' AS mime, 'https://i.example/' || n % 500 || '.png' AS image_url, CASE WHEN n % 12 <> 5 THEN 'https://i.example/t/' || n % 500 || '/' END AS thumb_url_prefix, CASE WHEN n % 12 <> 5 THEN 'px-x.png' END AS thumb_url_suffix
  FROM {0} QUALIFY row_number() OVER (PARTITION BY title ORDER BY timestamp) = 1"""
RAW_SQL |= {"a15_image_info": _IMAGE.format("(SELECT * FROM cache WHERE n % 9 <> 0)"), "d20_image_info": _IMAGE.format("(SELECT * FROM newest WHERE (age <= 30 OR r > 10) AND n % 9 <> 0)")}

ORACLE_SQL = {name: with_tables(sql, TABLES) for name, sql in RAW_SQL.items()}
