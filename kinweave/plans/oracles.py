"""SQL for the queries, written apart from them: literal joins and recursive tables."""

from __future__ import annotations

_NORM = "lower(regexp_replace(coalesce(CAST({} AS VARCHAR), ''), '[[:punct:]]', '', 'g'))"


def _records(table: str, key: str, columns: list[str]) -> str:
    attrs = ", ".join(f"{_NORM.format(c)} AS attr_{i}" for i, c in enumerate(columns, 1))
    return f"""rec AS (SELECT CAST({key} AS BIGINT) AS row_id, CAST({key} AS VARCHAR) AS rec_id, {attrs} FROM {table}),
kc AS (SELECT *, attr_1 || attr_2 || attr_3 || attr_4 AS full_key FROM rec),
keyed AS (SELECT *, rtrim(full_key, '0') AS dup_key FROM kc),
uniq0 AS (SELECT dup_key, min(row_id) AS u, arg_min(rec_id, row_id) AS rec_id, arg_min(attr_1, row_id) AS attr_1,
  arg_min(attr_2, row_id) AS attr_2, arg_min(attr_3, row_id) AS attr_3, arg_min(attr_4, row_id) AS attr_4,
  arg_min(full_key, row_id) AS full_key, count(*) AS n_dups FROM keyed GROUP BY dup_key),
uniq AS (SELECT *, rpad(full_key, CAST((SELECT greatest(1, max(length(full_key))) FROM kc) AS INTEGER), '0') AS ord_key FROM uniq0)"""


PART = _records("part", "p_partkey", ["p_name", "p_brand", "p_type", "p_size"])
CUSTOMER = _records("customer", "c_custkey", ["c_name", "c_mktsegment", "c_nationkey", "''"])


def _filled(v: str) -> str:
    return f"rpad({v}, CAST(greatest(3, length({v})) AS INTEGER), 'a')"


def _kmers(v: str) -> str:
    s = f"regexp_replace({_filled(v)}, '[^a-z0-9]', 'a', 'g')"
    return f"list_transform(range(1, length({_filled(v)}) + 1), lambda j: substr({s} || {s}, j, 3))"


def _super(v: str) -> str:
    return f"list_distinct(list_transform({_kmers(v)}, lambda m: substr({_filled(v)}, 1, 1) || m))"


def _headless(v: str) -> str:
    return f"[rtrim({v}, '0'), rtrim(substr({v}, 2), '0')]"


_DIGIT = "CASE WHEN ascii({0}) BETWEEN 97 AND 122 THEN ascii({0}) - 97 WHEN ascii({0}) BETWEEN 48 AND 57 THEN ascii({0}) - 22 ELSE 0 END"
_CODE = "CAST(" + " + ".join(f"({_DIGIT.format(f'substr(kmer, {i + 1}, 1)')}) * {36**i}" for i in range(3)) + " AS BIGINT)"


def _linked(a: str = "a", b: str = "b") -> str:
    d = [f"levenshtein({a}.attr_{i}, {b}.attr_{i})" for i in range(1, 5)]
    short = " AND ".join(f"abs(length({a}.attr_{i}) - length({b}.attr_{i})) <= 1" for i in range(1, 5))
    return f"{short} AND {' AND '.join(f'{x} <= 1' for x in d)} AND {' + '.join(d)} <= 1"


EXACT = f"exact AS (SELECT a.u AS u1, b.u AS u2 FROM uniq a JOIN uniq b ON a.u < b.u AND {_linked()})"


def _block(attr: str) -> str:
    return f"""blk AS (SELECT u, unnest({_super(attr)}) AS block FROM uniq),
bpair AS (SELECT DISTINCT a.u AS u1, b.u AS u2 FROM blk a JOIN blk b ON a.block = b.block AND a.u < b.u)"""


def _head(attr: str) -> str:
    return f"""hk AS (SELECT DISTINCT u, unnest({_headless(attr)}) AS block FROM uniq),
hpair AS (SELECT DISTINCT a.u AS u1, b.u AS u2 FROM hk a JOIN hk b ON a.block = b.block AND a.u < b.u)"""


def _adjacent(attr: str) -> str:
    return f"""hk2 AS (SELECT u, ord_key, rtrim({attr}, '0') AS block, 0 AS shifted FROM uniq
  UNION ALL SELECT u, ord_key, rtrim(substr({attr}, 2), '0'), 1 FROM uniq),
hlag AS (SELECT u, lag(u) OVER (PARTITION BY block ORDER BY shifted, ord_key, u) AS p FROM hk2),
apair AS (SELECT DISTINCT least(u, p) AS u1, greatest(u, p) AS u2 FROM hlag WHERE p <> u)"""


def _verified(pairs: str) -> str:
    return f"SELECT p.u1, p.u2 FROM {pairs} p JOIN uniq a ON a.u = p.u1 JOIN uniq b ON b.u = p.u2 WHERE {_linked()}"


def _links(attr: str) -> str:
    """The literal route: block pairs and headless pairs, compared."""
    return f"{_block(attr)}, {_head(attr)}, cand AS (SELECT * FROM bpair UNION SELECT * FROM hpair), links AS ({_verified('cand')})"


def _components(links: str, name: str = "comps", nodes: str = "uniq") -> str:
    return f"""{name}_e AS (SELECT u1 AS x, u2 AS y FROM {links} UNION SELECT u2, u1 FROM {links}),
{name}_r AS (SELECT u AS n, u AS c FROM {nodes} UNION SELECT e.y, r.c FROM {name}_r r JOIN {name}_e e ON e.x = r.n WHERE r.c < e.y),
{name} AS (SELECT n AS u, min(c) AS comp FROM {name}_r GROUP BY n)"""


_INSIDE = """inside AS (SELECT a.comp, x.u1, x.u2 FROM exact x JOIN comps a ON a.u = x.u1 JOIN comps b ON b.u = x.u2 WHERE a.comp = b.comp)"""
#: The sequential rule: in order, a record joins the leaders if none of its smaller linked records leads.
_LEADERS = f"""{_INSIDE},
numbered AS (SELECT u, row_number() OVER (ORDER BY ord_key, u) AS k FROM uniq WHERE u IN (SELECT u1 FROM inside UNION SELECT u2 FROM inside)),
smaller AS (SELECT hi.k, list(lo.k) AS below FROM (SELECT u1, u2 FROM inside UNION SELECT u2, u1 FROM inside) e
  JOIN numbered hi ON hi.u = e.u1 JOIN numbered lo ON lo.u = e.u2 AND lo.k < hi.k GROUP BY hi.k),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS led
  UNION ALL SELECT w.k + 1, CASE WHEN list_has_any(w.led, coalesce(s.below, [])) THEN w.led ELSE list_append(w.led, w.k + 1) END
  FROM walk w LEFT JOIN smaller s ON s.k = w.k + 1 WHERE w.k < (SELECT count(*) FROM numbered)),
led AS (SELECT unnest(led) AS k FROM walk WHERE k = (SELECT count(*) FROM numbered)),
owned AS (SELECT s.k, min(l.k) AS lk FROM smaller s JOIN led l ON list_contains(s.below, l.k) WHERE s.k NOT IN (SELECT k FROM led) GROUP BY s.k),
clusters AS (SELECT x.u, coalesce(y.u, x.u) AS leader FROM uniq x LEFT JOIN numbered n ON n.u = x.u
  LEFT JOIN owned o ON o.k = n.k LEFT JOIN numbered y ON y.k = o.lk)"""

_DICT = """vals AS (SELECT u, ord_key, unnest([1, 2, 3, 4]) AS attr, unnest([attr_1, attr_2, attr_3, attr_4]) AS value FROM uniq),
dict AS (SELECT attr, rtrim(value, '0') AS value_key, arg_min(u, (ord_key, u)) AS v, arg_min(value, (ord_key, u)) AS value, count(*) AS n
  FROM vals GROUP BY attr, rtrim(value, '0'))"""
_DICT_LINKS = f"""{_DICT},
dblk AS (SELECT attr, value_key, value, unnest(list_distinct({_kmers('value')})) AS block FROM dict),
dlink AS (SELECT DISTINCT a.attr, a.value_key AS key1, b.value_key AS key2 FROM dblk a JOIN dblk b
  ON a.attr = b.attr AND a.block = b.block AND a.value_key < b.value_key AND levenshtein(a.value, b.value) <= 1)"""
_DICT_CLUSTERS = f"""{_DICT_LINKS},
de AS (SELECT attr, key1 AS x, key2 AS y FROM dlink UNION SELECT attr, key2, key1 FROM dlink),
dr AS (SELECT attr, value_key AS n, value_key AS c FROM dict UNION SELECT e.attr, e.y, r.c FROM dr r JOIN de e ON e.attr = r.attr AND e.x = r.n WHERE r.c < e.y),
dc AS (SELECT attr, n, min(c) AS cluster FROM dr GROUP BY attr, n),
ac AS (SELECT v.attr, v.u, dc.cluster FROM vals v JOIN dc ON dc.attr = v.attr AND dc.n = rtrim(v.value, '0'))"""
_GATED = """gated AS (SELECT l.u1, l.u2 FROM links l WHERE NOT EXISTS (
  SELECT 1 FROM ac a JOIN ac b ON a.attr = b.attr WHERE a.u = l.u1 AND b.u = l.u2 AND a.cluster <> b.cluster))"""


def _with(*tables: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(tables) + "\n"


_HASHED = "md5(CAST(row_id AS VARCHAR)), row_id"
_BUCKETS = f"""sample AS (SELECT dup_key FROM keyed ORDER BY {_HASHED} LIMIT 80),
ordered AS (SELECT dup_key, row_number() OVER (ORDER BY dup_key) AS i FROM sample),
bounds AS (SELECT dup_key AS b FROM ordered WHERE i % 10 = 0 AND i < 80),
placed AS (SELECT k.dup_key, (SELECT count(*) FROM bounds WHERE b < k.dup_key) AS bucket FROM keyed k)"""
_STATS = f"""blk AS (SELECT u, unnest({_super('attr_1')}) AS block FROM uniq),
stats AS (SELECT block, count(*) AS n, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS n_pairs FROM blk GROUP BY block)"""
_CHUNKS = f"""{_STATS},
run AS (SELECT *, coalesce(sum(n_pairs) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM stats),
share AS (SELECT greatest(1, (sum(n_pairs) + 19) // 20) AS s FROM stats),
chunks AS (SELECT CAST(least(start // (SELECT s FROM share), 19) AS BIGINT) AS chunk, count(*) AS n_blocks, CAST(sum(n_pairs) AS BIGINT) AS n_pairs FROM run GROUP BY 1)"""


def oracle_sql() -> dict[str, str]:
    p, c = PART, CUSTOMER
    links, comps = _links("attr_1"), _components("links")
    full = (p, links, comps, EXACT, _LEADERS)
    return {
        "normalize_part": _with(p) + "SELECT row_id, rec_id, attr_1, attr_2, attr_3, attr_4 FROM rec",
        "row_strings": _with(p) + "SELECT row_id, concat_ws('|', rec_id, attr_1, attr_2, attr_3, attr_4) AS line, CAST(5 AS BIGINT) AS n_values, attr_1 FROM rec",
        "dedupe_keys": _with(p) + "SELECT row_id, dup_key FROM keyed",
        "padded_keys": _with(p) + """, w AS (SELECT CAST(max(length(attr_1)) AS INTEGER) AS n, CAST(max(length(full_key)) AS INTEGER) AS m FROM kc)
SELECT row_id, rpad(full_key, m, '0') AS key, rpad(attr_1, n, '0') AS value, rpad(substr(attr_1, 2), n, '0') AS shifted, length(full_key) AS n_chars FROM kc, w""",
        "exact_groups": _with(p) + "SELECT dup_key, u, n_dups FROM uniq",
        "strict_groups": _with(p) + "SELECT min(row_id) AS u, count(*) AS n_dups FROM rec GROUP BY attr_1, attr_2, attr_3, attr_4",
        "unique_records": _with(p) + "SELECT u, rec_id, attr_1, attr_2, attr_3, attr_4, n_dups, ord_key FROM uniq",
        "exact_members": _with(p) + "SELECT q.u, k.row_id, k.rec_id FROM keyed k JOIN uniq q USING (dup_key)",
        "sorted_rank": _with(p) + "SELECT u, ord_key, dense_rank() OVER (ORDER BY ord_key) - 1 AS dense_id FROM uniq",
        "sorted_by_length": _with(p) + "SELECT row_id, dup_key, row_number() OVER (ORDER BY length(dup_key), dup_key, row_id) - 1 AS place FROM keyed",
        "sorted_plain": _with(p) + "SELECT row_id, dup_key, row_number() OVER (ORDER BY dup_key, row_id) - 1 AS place FROM keyed",
        "random_sample": _with(p) + f"SELECT row_id, dup_key FROM keyed ORDER BY {_HASHED} LIMIT 100",
        "range_buckets": _with(p, _BUCKETS) + "SELECT bucket, count(*) AS n, min(dup_key) AS low, max(dup_key) AS high FROM placed GROUP BY bucket",
        "kmer_blocks": _with(p) + f"SELECT u, unnest(list_distinct({_kmers('attr_1')})) AS block FROM uniq",
        "super_blocks": _with(p) + f"SELECT u, unnest({_super('attr_1')}) AS block FROM uniq",
        "kmer_codes": _with(p) + f""", k AS (SELECT row_id, attr_1, unnest({_kmers('attr_1')}) AS kmer, unnest(range(0, length({_filled('attr_1')}))) AS pos FROM rec)
SELECT row_id, pos, kmer, {_CODE} AS code, CAST((ascii(substr({_filled('attr_1')}, 1, 1)) - 97) * {36**3} AS BIGINT) + {_CODE} AS super_code FROM k""",
        "block_stats": _with(p, _STATS) + "SELECT * FROM stats",
        "block_totals": _with(p, _STATS) + "SELECT count(*) AS n_blocks, max(n) AS largest, CAST(sum(n_pairs) AS BIGINT) AS n_pairs FROM stats",
        "chunk_cost": _with(p, _CHUNKS) + "SELECT * FROM chunks",
        "chunk_balance": _with(p, _CHUNKS) + "SELECT min(n_pairs) AS least, max(n_pairs) AS most, CAST(sum(n_pairs) AS BIGINT) AS total FROM chunks",
        "headless_keys": _with(p) + "SELECT u, rtrim(attr_1, '0') AS block, false AS shifted FROM uniq UNION ALL SELECT u, rtrim(substr(attr_1, 2), '0'), true FROM uniq",
        "bounded_edit_distance": """SELECT a.s_suppkey AS k1, b.s_suppkey AS k2,
  CASE WHEN levenshtein(a.s_name, b.s_name) <= 2 THEN levenshtein(a.s_name, b.s_name) ELSE -1 END AS distance
FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""",
        "block_pairs": _with(p, _block("attr_1")) + "SELECT * FROM bpair",
        "headless_pairs": _with(p, _head("attr_1")) + "SELECT * FROM hpair",
        "headless_adjacent": _with(p, _adjacent("attr_1")) + "SELECT * FROM apair",
        "headless_links": _with(p, _adjacent("attr_1")) + _verified("apair"),
        "links": _with(p, links) + "SELECT * FROM links",
        "links_adjacent": _with(p, _block("attr_1"), _adjacent("attr_1"), "cand AS (SELECT * FROM bpair UNION SELECT * FROM apair)") + _verified("cand"),
        "links_exact": _with(p, EXACT) + "SELECT * FROM exact",
        "links_brand_blocks": _with(p, _links("attr_2")) + "SELECT * FROM links",
        "links_customer": _with(c, _links("attr_2")) + "SELECT * FROM links",
        "unconnected_pairs": _with(p, _block("attr_1"), _head("attr_1"), f"first AS ({_verified('hpair')})", _components("first"), recursive=True)
        + "SELECT p.u1, p.u2 FROM bpair p JOIN comps a ON a.u = p.u1 JOIN comps b ON b.u = p.u2 WHERE a.comp <> b.comp",
        "components": _with(p, links, comps, recursive=True) + "SELECT * FROM comps",
        "components_customer": _with(c, _links("attr_2"), comps, recursive=True) + "SELECT * FROM comps",
        "merged_components": _with(p, links, comps, recursive=True) + "SELECT * FROM comps",
        "component_sizes": _with(p, links, comps, recursive=True) + "SELECT comp, count(*) AS n FROM comps GROUP BY comp",
        "component_links": _with(p, links, comps, EXACT, _INSIDE, recursive=True) + "SELECT * FROM inside",
        "leader_clusters": _with(*full, recursive=True) + "SELECT * FROM clusters",
        "leader_clusters_customer": _with(c, _links("attr_2"), comps, EXACT, _LEADERS, recursive=True) + "SELECT * FROM clusters",
        "cluster_members": _with(*full, recursive=True)
        + "SELECT c.leader, c.u, k.row_id, k.rec_id, q.rec_id AS rep_rec_id FROM clusters c JOIN uniq q ON q.u = c.u JOIN keyed k ON k.dup_key = q.dup_key",
        "cluster_lines": _with(*full, recursive=True)
        + """SELECT c.leader, string_agg(q.rec_id || ',', '' ORDER BY c.u <> c.leader, q.ord_key, q.u, k.row_id) AS line
FROM clusters c JOIN uniq q ON q.u = c.u JOIN keyed k ON k.dup_key = q.dup_key GROUP BY c.leader""",
        "run_summary": _with(*full, recursive=True)
        + """SELECT (SELECT count(*) FROM rec) AS total_records, (SELECT count(*) FROM uniq) AS unique_records, (SELECT count(*) FROM links) AS links,
  (SELECT count(DISTINCT comp) FROM comps) AS components, (SELECT count(DISTINCT leader) FROM clusters) AS clusters,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM comps GROUP BY comp)) AS largest_component,
  (SELECT count(*) FROM uniq) - (SELECT count(DISTINCT comp) FROM comps) AS accepted_unions""",
        "attr_dictionary": _with(p, _DICT) + "SELECT CAST(attr AS BIGINT) AS attr, value_key, v, value, n FROM dict",
        "attr_blocks": _with(p, _DICT_LINKS) + "SELECT CAST(attr AS BIGINT) AS attr, block, count(*) AS n FROM dblk GROUP BY attr, block",
        "attr_links": _with(p, _DICT_LINKS) + "SELECT CAST(attr AS BIGINT) AS attr, key1, key2 FROM dlink",
        "attr_clusters": _with(p, _DICT_CLUSTERS, recursive=True) + "SELECT CAST(attr AS BIGINT) AS attr, u, cluster FROM ac",
        "token_gated_links": _with(p, links, _DICT_CLUSTERS, _GATED, recursive=True) + "SELECT * FROM gated",
        "token_gated_components": _with(p, links, _DICT_CLUSTERS, _GATED, _components("gated"), recursive=True) + "SELECT * FROM comps",
        "token_gated_clusters": _with(p, links, _DICT_CLUSTERS, _GATED, _components("gated"), EXACT, _LEADERS, recursive=True) + "SELECT * FROM clusters",
    }
