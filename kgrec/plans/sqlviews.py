"""DuckDB definitions of the derived views, used to build the oracle SQL of every query.

Each entry mirrors a builder in ``kgrec.sources`` / ``kgrec.operators``; ``with_views`` prepends the
needed CTEs (with their dependencies) to a query body.
"""

from __future__ import annotations

from kgrec.sources.tables import (ITEM_COMPLETION_SQL, ITEM_NAME_SQL, LIKE_QUANTITY, SEQ_STRIDE,
                                  TEST_MODULUS, USER_COMPLETION_SQL)

# name -> (dependencies, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, deps: tuple[str, ...], body: str) -> None:
    VIEWS[name] = (deps, body)


_view("interactions", (), f"""
SELECT user_id, item_id, CAST(l_quantity >= {LIKE_QUANTITY} AS BIGINT) AS rating,
       CAST(l_orderkey * {SEQ_STRIDE} + l_linenumber AS BIGINT) AS seq,
       CASE WHEN l_orderkey % {TEST_MODULUS} = 0 THEN 'test' ELSE 'train' END AS fold
FROM (SELECT o.o_custkey AS user_id, l.l_partkey AS item_id, l.l_quantity, l.l_orderkey, l.l_linenumber,
             row_number() OVER (PARTITION BY o.o_custkey, l.l_partkey
                                ORDER BY l.l_shipdate DESC, l.l_orderkey DESC, l.l_linenumber DESC) AS rn
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey) t
WHERE rn = 1""")
_view("train", ("interactions",), "SELECT user_id, item_id, rating, seq FROM interactions WHERE fold = 'train'")
_view("test", ("interactions",), "SELECT user_id, item_id, rating, seq FROM interactions WHERE fold = 'test'")
_view("items", (), f"SELECT p_partkey AS item_id, {ITEM_NAME_SQL} AS name FROM part")
_view("item_uris", ("items",), """
SELECT item_id, CASE WHEN contains(name, ';') THEN split_part(name, ';', 2) ELSE name END AS uri FROM items""")
_view("item_completions", (), f"SELECT p_partkey AS entity_id, {ITEM_COMPLETION_SQL} AS plain FROM part")
_view("user_completions", (), f"SELECT c_custkey AS entity_id, {USER_COMPLETION_SQL} AS plain FROM customer")
_view("raw_vectors", (), """
SELECT CASE WHEN vec_id % 2 = 0 THEN 'user' ELSE 'item' END AS kind, CAST(vec_id // 2 AS BIGINT) AS id,
       CAST(embedding AS DOUBLE[]) AS vec
FROM embeddings""")
_view("vectors", ("raw_vectors", "item_uris"), """
SELECT CASE WHEN r.kind = 'user' THEN 'user' || CAST(r.id AS VARCHAR) ELSE u.uri END AS entity, r.vec
FROM raw_vectors r LEFT JOIN item_uris u ON r.kind = 'item' AND r.id = u.item_id
WHERE (CASE WHEN r.kind = 'user' THEN 'user' || CAST(r.id AS VARCHAR) ELSE u.uri END) IS NOT NULL""")
# Long form of the vectors: one row per (entity, dim).
_view("vector_cells", ("vectors",), """
SELECT entity, CAST(d AS BIGINT) AS d, vec[d + 1] AS v FROM vectors, range(0, 64) t(d)""")


def with_views(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        deps, _ = VIEWS[n]
        for d in deps:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"


# ---- predictions -------------------------------------------------------------------------------
_view("train_pop", ("train",), "SELECT item_id, count(DISTINCT user_id) AS n_users FROM train GROUP BY item_id")
_view("pop_predictions", ("test", "train_pop"), """
SELECT 'pop' AS model, t.user_id, t.item_id, CAST(coalesce(p.n_users, 0) AS DOUBLE) AS score
FROM test t LEFT JOIN train_pop p USING (item_id)""")
_view("dot_predictions", ("test", "item_uris", "vectors"), """
SELECT 'dot' AS model, t.user_id, t.item_id,
       round(coalesce(list_dot_product(u.vec, v.vec), 0.0), 9) AS score
FROM test t LEFT JOIN item_uris i USING (item_id)
LEFT JOIN vectors u ON u.entity = 'user' || CAST(t.user_id AS VARCHAR)
LEFT JOIN vectors v ON v.entity = i.uri""")
_view("predictions", ("pop_predictions", "dot_predictions"),
      "SELECT * FROM pop_predictions UNION ALL SELECT * FROM dot_predictions")

# ---- metrics (k in 5, 10) ----------------------------------------------------------------------
_view("ranked_preds", ("predictions",), """
SELECT model, user_id, item_id, score,
       row_number() OVER (PARTITION BY model, user_id ORDER BY score DESC, item_id ASC) AS rank
FROM predictions""")
_view("lists", ("ranked_preds",), """
SELECT r.*, CAST(ks.k AS BIGINT) AS k FROM ranked_preds r, (VALUES (5), (10)) ks(k) WHERE r.rank <= ks.k""")
_view("popular", ("train_pop",), """
SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY n_users DESC, item_id ASC) AS pos FROM train_pop)
WHERE pos <= (SELECT (count(*) + 4) // 5 FROM train_pop)""")
_view("metric_rows", ("lists", "test", "train", "train_pop", "popular"), """
SELECT l.model, l.k, l.user_id, l.item_id, l.rank,
       coalesce(CAST(t.rating >= 1 AS DOUBLE), 0.0) AS rel,
       coalesce(p.n_users / (SELECT count(DISTINCT user_id) FROM train), 0.0) AS pop,
       CASE WHEN pp.item_id IS NULL THEN 0.0 ELSE 1.0 END AS is_pop
FROM lists l LEFT JOIN test t USING (user_id, item_id)
LEFT JOIN train_pop p USING (item_id) LEFT JOIN popular pp USING (item_id)""")
_view("user_agg", ("metric_rows", "test"), """
SELECT a.*, n.n_rel FROM (
  SELECT model, k, user_id, count(*) AS n_list, sum(rel) AS hits, sum(rel / log2(rank + 1)) AS dcg,
         sum((1.0 / log2(rank + 1)) * rel * (1.0 - pop)) AS epc_num, sum(1.0 / log2(rank + 1)) AS disc_sum,
         sum(1.0 - is_pop) AS n_tail
  FROM metric_rows GROUP BY model, k, user_id) a
JOIN (SELECT user_id, sum(CAST(rating >= 1 AS DOUBLE)) AS n_rel FROM test GROUP BY user_id) n USING (user_id)""")
_view("user_metric_vals", ("user_agg",), """
SELECT model, k, user_id, precision, recall,
       CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
       CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg, epc, aplt
FROM (SELECT model, k, user_id, hits / n_list AS precision,
             CASE WHEN n_rel > 0 THEN hits / n_rel ELSE 0.0 END AS recall, dcg,
             coalesce(list_sum(list_transform(range(1, CAST(least(k, n_rel) AS BIGINT) + 1),
                                              lambda r: 1.0 / log2(r + 1))), 0.0) AS idcg,
             epc_num / disc_sum AS epc, n_tail / n_list AS aplt
      FROM user_agg)""")
_view("gini_vals", ("lists",), """
SELECT model, k, CAST(sum((2 * i - n - 1) * x) AS DOUBLE) / (max(n) * sum(x)) AS gini
FROM (SELECT model, k, item_id, x, row_number() OVER (PARTITION BY model, k ORDER BY x, item_id) AS i,
             count(*) OVER (PARTITION BY model, k) AS n
      FROM (SELECT model, k, item_id, count(*) AS x FROM lists GROUP BY model, k, item_id))
GROUP BY model, k""")
_view("system_vals", ("user_metric_vals", "gini_vals"), """
SELECT m.model, m.k, m.precision, m.recall, m.f1, m.ndcg, g.gini, m.epc, m.aplt
FROM (SELECT model, k, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(ndcg) AS ndcg,
             avg(epc) AS epc, avg(aplt) AS aplt FROM user_metric_vals GROUP BY model, k) m
JOIN gini_vals g USING (model, k)""")

# ---- completion parsing and triples ------------------------------------------------------------
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x=x)


def _parsed_sql(src: str) -> str:
    line = "line"
    parts = f"string_split({_strip(line)}, ': ')"
    feature = f"lower(string_split({_strip(f'replace({line}, {chr(39)}Favourite {chr(39)}, {chr(39)}{chr(39)})')}, ': ')[1])"
    values = f"string_split(lower({parts}[2]), ', ')"
    return f"""
SELECT entity_id, feature, arg_max(vals, pos) AS vals FROM (
  SELECT entity_id, pos, {feature} AS feature, {values} AS vals
  FROM (SELECT entity_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
        FROM (SELECT entity_id, string_split(replace(replace(plain, '<', ''), '>', ''), '.') AS ls FROM {src}))
  WHERE len({parts}) >= 2)
GROUP BY entity_id, feature"""


def _keymap_sql(m: dict[str, str]) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in sorted(m.items()))
    return f"SELECT * FROM (VALUES {rows}) t(feature, key)"


from kgrec.functions.keymaps import BOOK_ITEM_KEYS, BOOK_USER_KEYS  # noqa: E402

_view("item_props", ("item_completions",), _parsed_sql("item_completions"))
_view("user_props", ("user_completions",), _parsed_sql("user_completions"))
_view("item_keymap", (), _keymap_sql(BOOK_ITEM_KEYS))
_view("user_keymap", (), _keymap_sql(BOOK_USER_KEYS))
_view("item_norm", ("item_props", "item_keymap"), """
SELECT entity_id, key, feature, CAST(pos - 1 AS INTEGER) AS value_pos, value FROM (
  SELECT p.entity_id, m.key, p.feature, unnest(p.vals) AS value, generate_subscripts(p.vals, 1) AS pos
  FROM item_props p JOIN item_keymap m USING (feature))""")
_view("user_norm", ("user_props", "user_keymap"), """
SELECT entity_id, key, feature, CAST(pos - 1 AS INTEGER) AS value_pos, value FROM (
  SELECT p.entity_id, m.key, p.feature, unnest(p.vals) AS value, generate_subscripts(p.vals, 1) AS pos
  FROM user_props p JOIN user_keymap m USING (feature))""")
_view("llm_item_graph", ("item_norm", "item_uris"), """
SELECT DISTINCT u.uri AS head, 'llama_generated/' || n.key AS relation,
       'llama_generated/' || replace(n.value, ' ', '_') AS tail
FROM item_norm n JOIN item_uris u ON u.item_id = n.entity_id""")
_view("llm_user_graph", ("user_norm",), f"""
SELECT DISTINCT 'user' || CAST(entity_id AS VARCHAR) AS head, 'llama_generated/' || key AS relation,
       'llama_generated/' || replace(value, ' ', '_') AS tail
FROM user_norm WHERE {_strip('value')} <> ''""")
_view("cf_graph", ("train", "item_uris"), """
SELECT 'user' || CAST(t.user_id AS VARCHAR) AS head,
       CASE WHEN t.rating >= 1 THEN 'like' ELSE 'dislike' END AS relation, u.uri AS tail
FROM train t JOIN item_uris u USING (item_id)""")
_view("catalog_graph", ("item_uris",), """
SELECT u.uri AS head, 'brand' AS relation, 'brand/' || p.p_brand AS tail FROM part p JOIN item_uris u ON u.item_id = p.p_partkey
UNION ALL SELECT u.uri, 'type', 'type/' || p.p_type FROM part p JOIN item_uris u ON u.item_id = p.p_partkey
UNION ALL SELECT 'user' || CAST(c_custkey AS VARCHAR), 'nation', 'nation/' || CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT 'user' || CAST(c_custkey AS VARCHAR), 'segment', 'segment/' || c_mktsegment FROM customer
UNION ALL SELECT 'nation/' || CAST(n_nationkey AS VARCHAR), 'region', 'region/' || CAST(n_regionkey AS VARCHAR) FROM nation""")
_view("kg_tagged", ("cf_graph", "catalog_graph", "llm_user_graph", "llm_item_graph"), """
SELECT head, relation, tail, bit_or(bit) AS mask FROM (
  SELECT head, relation, tail, 1 AS bit FROM cf_graph
  UNION ALL SELECT head, relation, tail, 2 FROM catalog_graph
  UNION ALL SELECT head, relation, tail, 4 FROM llm_user_graph
  UNION ALL SELECT head, relation, tail, 8 FROM llm_item_graph)
GROUP BY head, relation, tail""")
_view("imputed_cells", ("rating_entities", "vectors", "vector_cells"), """
SELECT entity, d, CASE WHEN vec IS NULL THEN mean + std * (sqrt(-2.0 * ln(u1)) * cos(2 * pi() * u2)) ELSE vec[d + 1] END AS v FROM (
  SELECT r.entity, v.vec, CAST(t.d AS BIGINT) AS d,
         (CAST('0x' || substr(md5(r.entity || '|' || t.d || '|42|1'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u1,
         (CAST('0x' || substr(md5(r.entity || '|' || t.d || '|42|2'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u2
  FROM (SELECT DISTINCT entity FROM rating_entities) r LEFT JOIN vectors v USING (entity), range(0, 64) t(d)),
 (SELECT avg(v) AS mean, stddev_pop(v) AS std FROM vector_cells)""")

_view("imputed", ("imputed_cells",), "SELECT entity, list(v ORDER BY d) AS vec FROM imputed_cells GROUP BY entity")

_view("full_kg", ("kg_tagged",), "SELECT head, relation, tail FROM kg_tagged")
_view("kg_entities", ("full_kg",), """
SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS id
FROM (SELECT head AS name FROM full_kg UNION SELECT tail FROM full_kg)""")
_view("kg_relations", ("full_kg",), """
SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS id
FROM (SELECT DISTINCT relation AS name FROM full_kg)""")

# ---- vectors -----------------------------------------------------------------------------------
_view("rating_entities", ("interactions", "item_uris"), """
SELECT DISTINCT 'user' AS kind, 'user' || CAST(user_id AS VARCHAR) AS entity, fold FROM interactions
UNION SELECT DISTINCT 'item', u.uri, i.fold FROM interactions i JOIN item_uris u USING (item_id)""")
_view("kg_edges", ("full_kg",), """
SELECT src, dst, 1.0 / sqrt(CAST(ds.deg AS DOUBLE) * dd.deg) AS w FROM
  (SELECT DISTINCT src, dst FROM (SELECT head AS src, tail AS dst FROM full_kg UNION ALL
                                  SELECT tail, head FROM full_kg)) e
  JOIN (SELECT src AS n, count(*) AS deg FROM (SELECT DISTINCT src, dst FROM (
          SELECT head AS src, tail AS dst FROM full_kg UNION ALL SELECT tail, head FROM full_kg)) GROUP BY src) ds
    ON ds.n = e.src
  JOIN (SELECT src AS n, count(*) AS deg FROM (SELECT DISTINCT src, dst FROM (
          SELECT head AS src, tail AS dst FROM full_kg UNION ALL SELECT tail, head FROM full_kg)) GROUP BY src) dd
    ON dd.n = e.dst""")
_view("ui_edges", ("train", "item_uris"), """
WITH p AS (SELECT DISTINCT 'user' || CAST(t.user_id AS VARCHAR) AS x, u.uri AS y
           FROM train t JOIN item_uris u USING (item_id)),
     b AS (SELECT x AS src, y AS dst FROM p UNION ALL SELECT y, x FROM p),
     g AS (SELECT src, count(*) AS deg FROM b GROUP BY src)
SELECT b.src, b.dst, 1.0 / sqrt(CAST(g1.deg AS DOUBLE) * g2.deg) AS w
FROM b JOIN g g1 ON g1.src = b.src JOIN g g2 ON g2.src = b.dst""")
