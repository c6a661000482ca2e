"""DuckDB SQL with the rows of the catalogue's queries."""

from __future__ import annotations

BIP = "bip AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, epoch_us(l_shipdate) / 1e6 AS t FROM lineitem)"
CUTS = "cuts AS (SELECT quantile_cont(t, [0.0, 0.25, 0.5, 0.75, 1.0]) AS c FROM bip)"
SNAPS = """snaps AS (
  SELECT DISTINCT least(3, (t >= c[2])::INT + (t >= c[3])::INT + (t >= c[4])::INT) AS snap, least(src, dst) AS u, greatest(src, dst) AS v FROM bip, cuts)"""
WINDOWS = f"{BIP}, {CUTS}, {SNAPS}"
FIRST = f"{WINDOWS}, e AS (SELECT u, v FROM snaps WHERE snap = 0), ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e)"
DELTA = """delta AS (
  SELECT snap, 'add' AS op, u, v FROM snaps a WHERE snap >= 1 AND NOT EXISTS (SELECT 1 FROM snaps b WHERE b.snap = a.snap - 1 AND b.u = a.u AND b.v = a.v)
  UNION ALL
  SELECT snap + 1, 'remove', u, v FROM snaps a WHERE snap < 3 AND NOT EXISTS (SELECT 1 FROM snaps b WHERE b.snap = a.snap + 1 AND b.u = a.u AND b.v = a.v))"""
ENTRIES = """ids AS (SELECT DISTINCT u AS node_id FROM ways),
deg AS (SELECT node_id, (count(ways.u) + 1)::DOUBLE AS d FROM ids LEFT JOIN ways ON ways.u = node_id GROUP BY node_id),
entries AS (SELECT x.u, x.v, 1.0 / sqrt(a.d * b.d) AS w FROM (SELECT u, v FROM ways UNION ALL SELECT node_id, node_id FROM ids) x JOIN deg a ON a.node_id = x.u JOIN deg b ON b.node_id = x.v)"""
SCALED = f"{FIRST}, {ENTRIES}"
EMB = "emb AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS vec, label::BIGINT AS label FROM embeddings)"
UNIT = f"{EMB}, unit AS (SELECT node_id, label, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) AS vec FROM emb)"
PAPERS = """papers AS (
  SELECT o_orderkey AS seq, o_orderkey::VARCHAR AS id, year(o_orderdate) AS year, lower(o_orderpriority) AS venue,
    coalesce((SELECT list(l_partkey::VARCHAR) FROM lineitem WHERE l_orderkey = o_orderkey), []) AS refs FROM orders),
venues AS (SELECT venue, row_number() OVER (ORDER BY venue) - 1 AS label FROM papers GROUP BY venue HAVING count(*) >= 100),
listed AS (SELECT id, unnest(refs) AS ref FROM papers),
incoming AS (SELECT ref AS id, count(*) AS in_count FROM listed WHERE id <> ref GROUP BY ref),
scored AS (
  SELECT p.*, v.label, coalesce(i.in_count, 0) AS in_count, len(refs) AS out_count,
    coalesce(i.in_count, 0) + 0.5::DOUBLE * len(refs) + CASE WHEN v.label IS NOT NULL THEN 5.0::DOUBLE ELSE 0 END AS score
  FROM papers p LEFT JOIN incoming i USING (id) LEFT JOIN venues v USING (venue))"""
SPLIT = f"""{UNIT}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || node_id), node_id) AS nth, count(*) OVER (PARTITION BY label) AS n FROM unit),
split AS (SELECT *, nth <= greatest(1, least(n - 1, round_even(n * 0.7, 0)::BIGINT)) AS train FROM ranked)"""
PREDICTED = f"""{SPLIT}, cells AS (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS j, train FROM split),
sums AS (SELECT label, j, avg(x) AS m FROM cells WHERE train GROUP BY label, j),
means AS (SELECT label AS class, list(m ORDER BY j) AS mean FROM sums GROUP BY label),
guess AS (SELECT s.node_id, s.label, m.class, list_dot_product(s.vec, list_transform(m.mean, lambda x: x / sqrt(list_dot_product(m.mean, m.mean)))) AS score FROM split s, means m WHERE NOT s.train),
predicted AS (SELECT node_id, label, arg_max(class, (score, -class)) AS pred FROM guess GROUP BY node_id, label),
truth AS (SELECT DISTINCT label AS class FROM predicted),
cells3 AS (SELECT class, count(*) FILTER (label = class AND pred = class) AS tp, count(*) FILTER (label <> class AND pred = class) AS fp, count(*) FILTER (label = class AND pred <> class) AS fn FROM truth, predicted GROUP BY class)"""


def _u(seed: int, *keys: str) -> str:
    """A uniform number from the first 32 bits of an MD5 digest."""
    joined = " || '|' || ".join([f"'{seed}'", *keys])
    return f"(('0x' || substr(md5({joined}), 1, 8))::UBIGINT::DOUBLE / 4294967296.0)"


def _ternary(density: float, d: int, *keys: str) -> str:
    u = _u(42, *keys)
    return f"(CASE WHEN {u} < {density / 2} THEN -1.0 WHEN {u} >= {1 - density / 2} THEN 1.0 ELSE 0.0 END / sqrt({density * d}::DOUBLE))"


def _anchor() -> str:
    """Over all edges, at the projection model's default width and density."""
    cols = range(32)
    whole = f"{BIP}, e AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM bip WHERE src <> dst), ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), {ENTRIES}"
    start = ", ".join(f"{_ternary(0.1, 32, 'node_id', repr(str(j)))} AS y{j}" for j in cols)
    step = lambda name, src: f"{name} AS (SELECT x.u AS node_id, " + ", ".join(f"sum(x.w * r.y{j}) AS y{j}" for j in cols) + f" FROM entries x JOIN {src} r ON r.node_id = x.v GROUP BY x.u)"
    total = ", ".join(f"r0.y{j} * 6.0::DOUBLE / 11 + r1.y{j} * 3.0::DOUBLE / 11 + r2.y{j} * 2.0::DOUBLE / 11 AS y{j}" for j in cols)
    norm = "greatest(sqrt(" + " + ".join(f"y{j} * y{j}" for j in cols) + "), 1e-12)"
    return f"WITH {whole}, r0 AS (SELECT node_id, {start} FROM ids), {step('r1', 'r0')}, {step('r2', 'r1')}, total AS (SELECT r0.node_id, {total} FROM r0 JOIN r1 USING (node_id) JOIN r2 USING (node_id)) SELECT node_id, " + ", ".join(f"round(y{j} / {norm}, 6) + 0.0::DOUBLE AS y{j}" for j in cols) + " FROM total"


def _restart() -> str:
    """Two structure updates in turn, from unit rows of the sparse projection."""
    cols = range(4)
    norm = "greatest(sqrt(" + " + ".join(f"y{k} * y{k}" for k in cols) + "), 1e-12)"
    unit = ", ".join(f"y{j} / {norm} AS y{j}" for j in cols)
    drawn = ", ".join(f"{_ternary(0.5, 4, 'node_id', repr(str(j)))} AS y{j}" for j in cols)
    parts = [f"drawn AS (SELECT node_id, {drawn} FROM (SELECT u AS node_id FROM snaps WHERE snap <= 2 UNION SELECT v FROM snaps WHERE snap <= 2)), y0 AS (SELECT node_id, {unit} FROM drawn)"]
    for t in (1, 2):
        push = ", ".join(f"sum(w * o.y{j}) AS d{j}" for j in cols)
        moved = ", ".join(f"CASE WHEN p.d0 IS NULL THEN o.y{j} ELSE o.y{j} + 0.55::DOUBLE / greatest(coalesce(g.n, 0), 1) * p.d{j} END AS y{j}" for j in cols)
        final = ", ".join(f"CASE WHEN changed THEN y{j} / {norm} ELSE y{j} END AS y{j}" for j in cols)
        parts.append(f"""e{t} AS (SELECT u, v, CASE op WHEN 'add' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS w FROM delta WHERE snap = {t}), s{t} AS (SELECT * FROM e{t} UNION ALL SELECT v, u, w FROM e{t}),
p{t} AS (SELECT s.u AS node_id, {push} FROM s{t} s JOIN y{t - 1} o ON o.node_id = s.v GROUP BY s.u),
g{t} AS (SELECT node_id, count(*) AS n FROM (SELECT u AS node_id FROM snaps WHERE snap = {t} UNION ALL SELECT v FROM snaps WHERE snap = {t}) GROUP BY node_id),
m{t} AS (SELECT o.node_id, p.d0 IS NOT NULL AS changed, {moved} FROM y{t - 1} o LEFT JOIN p{t} p USING (node_id) LEFT JOIN g{t} g USING (node_id)), y{t} AS (SELECT node_id, {final} FROM m{t})""")
    return f"WITH {WINDOWS}, {DELTA}, {', '.join(parts)} SELECT node_id, " + ", ".join(f"round(y{j}, 6) + 0.0::DOUBLE AS y{j}" for j in cols) + " FROM y2"


def _incremental() -> str:
    cols = range(4)
    old = ", ".join(f"{_ternary(0.5, 4, 'node_id', repr(str(j)))} AS y{j}" for j in cols)
    push = ", ".join(f"sum(w * o.y{j}) AS d{j}" for j in cols)
    moved = ", ".join(f"CASE WHEN p.d0 IS NULL THEN o.y{j} ELSE o.y{j} + 0.55::DOUBLE / greatest(coalesce(g.n, 0), 1) * p.d{j} END AS y{j}" for j in cols)
    norm = "greatest(sqrt(" + " + ".join(f"y{j} * y{j}" for j in cols) + "), 1e-12)"
    final = ", ".join(f"round(CASE WHEN changed THEN y{j} / {norm} ELSE y{j} END, 6) + 0.0::DOUBLE AS y{j}" for j in cols)
    return f"""WITH {WINDOWS}, {DELTA}, d1 AS (SELECT op, u, v FROM delta WHERE snap = 1),
after AS (SELECT u, v FROM snaps WHERE snap = 1), before AS (SELECT u, v FROM snaps WHERE snap = 0),
ids AS (SELECT u AS node_id FROM after UNION SELECT v FROM after UNION SELECT u FROM before UNION SELECT v FROM before),
old AS (SELECT node_id, {old} FROM ids),
signed AS (SELECT u, v, CASE op WHEN 'add' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS w FROM d1 UNION ALL SELECT v, u, CASE op WHEN 'add' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END FROM d1),
push AS (SELECT s.u AS node_id, {push} FROM signed s JOIN old o ON o.node_id = s.v GROUP BY s.u),
deg AS (SELECT node_id, count(*) AS n FROM (SELECT u AS node_id FROM after UNION ALL SELECT v FROM after) GROUP BY node_id),
moved AS (SELECT o.node_id, p.d0 IS NOT NULL AS changed, {moved} FROM old o LEFT JOIN push p USING (node_id) LEFT JOIN deg g USING (node_id))
SELECT node_id, {final} FROM moved"""


def _fuse() -> str:
    """Moebius fusion of two unit 4-vectors with gate 0.3, by closed form."""
    tanh1 = "0.7615941559557649"
    return f"""WITH {EMB}, half AS (SELECT node_id, vec[1:4] AS a, vec[5:8] AS b FROM emb),
unit AS (SELECT node_id, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS a, list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))) AS b FROM half),
up AS (SELECT node_id, list_transform(a, lambda x: tanh(0.3 * atanh({tanh1}::DOUBLE)) * x) AS a, list_transform(b, lambda x: tanh(0.7 * atanh({tanh1}::DOUBLE)) * x) AS b FROM unit),
dots AS (SELECT *, list_dot_product(a, b) AS ab, list_dot_product(a, a) AS aa, list_dot_product(b, b) AS bb FROM up),
added AS (SELECT node_id, list_transform(list_zip(a, b), lambda p: ((1 + 2 * ab + bb) * p[1] + (1 - aa) * p[2]) / greatest(1 + 2 * ab + aa * bb, 1e-12)) AS c FROM dots),
down AS (SELECT node_id, c, sqrt(list_dot_product(c, c)) AS n FROM added)
SELECT node_id, {", ".join(f"round(c[{j + 1}] / n, 6) AS f{j}" for j in range(4))} FROM down"""


QUANT = f"""{EMB}, cells AS (SELECT node_id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS dim FROM emb),
scales AS (SELECT dim, greatest(max(abs(x)) / 127.0::DOUBLE, 1e-8) AS s FROM cells GROUP BY dim),
quantized AS (SELECT node_id, dim, x, s, greatest(-127.0, least(127.0, round_even(x / s, 0))) AS q FROM cells JOIN scales USING (dim))"""
PV = "rows_ AS (SELECT event_type = 'purchase' AS positive, value AS score FROM events WHERE event_type IN ('purchase', 'view'))"

ORACLE: dict[str, str] = {
    "flagship": f"WITH {WINDOWS}, {DELTA} SELECT snap, op, count(*) AS edges FROM delta GROUP BY snap, op",
    "edges_clean_undirected": f"WITH {BIP} SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM bip WHERE src <> dst",
    "node_index": f"WITH {BIP}, n AS (SELECT src AS node_id FROM bip UNION SELECT dst FROM bip) SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS idx FROM n",
    "node_universe": f"WITH {BIP} SELECT src AS node_id FROM bip UNION SELECT dst FROM bip UNION SELECT 'p' || p_partkey FROM part UNION SELECT 's' || s_suppkey FROM supplier",
    "degree_topn": f"WITH {BIP}, d AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM bip UNION ALL SELECT dst FROM bip) GROUP BY node_id) SELECT * FROM d ORDER BY degree DESC, node_id LIMIT 50",
    "downsample_edges": f"WITH {BIP}, d AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM bip UNION ALL SELECT dst FROM bip) GROUP BY node_id ORDER BY degree DESC, node_id LIMIT 200) SELECT src, dst, count(*) AS n FROM bip WHERE src IN (SELECT node_id FROM d) AND dst IN (SELECT node_id FROM d) GROUP BY src, dst",
    "downsample_nodes": f"""WITH {BIP}, n AS (SELECT 'p' || p_partkey AS node_id FROM part UNION SELECT 's' || s_suppkey FROM supplier UNION SELECT 'c' || c_custkey FROM customer),
d AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM bip UNION ALL SELECT dst FROM bip) GROUP BY node_id)
SELECT node_id, coalesce(degree, 0) AS degree FROM n LEFT JOIN d USING (node_id) QUALIFY row_number() OVER (ORDER BY coalesce(degree, 0) DESC, node_id) <= (SELECT count(*) * 3 // 4 FROM n)""",
    "snapshot_window": f"WITH {WINDOWS} SELECT snap, u, v FROM snaps",
    "snapshot_cumulative": f"WITH {WINDOWS}, f AS (SELECT u, v, min(snap) AS first FROM snaps GROUP BY u, v) SELECT s.snap::INT AS snap, count(*) AS edges FROM f JOIN range(0, 4) s(snap) ON s.snap >= first GROUP BY s.snap",
    "snapshot_equal_count": """WITH r AS (SELECT 'p' || l_partkey AS u, 's' || l_suppkey AS v, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS k, count(*) OVER () AS n FROM lineitem)
SELECT snap, count(*) AS edges FROM (SELECT DISTINCT (k >= floor(1 * (n / 4)))::INT + (k >= floor(2 * (n / 4)))::INT + (k >= floor(3 * (n / 4)))::INT AS snap, u, v FROM r) GROUP BY snap""",
    "snapshot_delta": f"WITH {WINDOWS}, {DELTA} SELECT snap, op, u, v FROM delta",
    "delta_replay": f"WITH {WINDOWS} SELECT u, v FROM snaps WHERE snap = 1",
    "batch_event_counts": f"WITH {WINDOWS}, {DELTA} SELECT snap, count(*) FILTER (op = 'add') AS added, count(*) FILTER (op = 'remove') AS removed, count(*) AS events FROM delta GROUP BY snap",
    "attr_update_bins": """WITH r AS (SELECT epoch_us(ts) / 1e6 AS t, user_id, event_id, value FROM events), c AS (SELECT quantile_cont(t, [0.0, 0.25, 0.5, 0.75, 1.0]) AS c FROM r),
b AS (SELECT CASE WHEN t >= c[1] AND t <= c[2] THEN 0 WHEN t >= c[2] AND t <= c[3] THEN 1 WHEN t >= c[3] AND t <= c[4] THEN 2 ELSE 3 END AS snap, r.* FROM r, c)
SELECT snap, user_id, arg_max(value, event_id) AS value FROM b WHERE snap > 0 GROUP BY snap, user_id""",
    "affected_nodes": f"""WITH {WINDOWS}, touched AS (SELECT unnest(['s1', 's2', 'p3']) AS node_id), ways AS (SELECT u, v FROM snaps WHERE snap <= 1 UNION SELECT v, u FROM snaps WHERE snap <= 1)
SELECT node_id FROM touched UNION SELECT v FROM ways JOIN touched ON u = node_id""",
    "norm_adjacency": f"WITH {SCALED} SELECT u, v, round(w, 9) AS w FROM entries",
    "laplacian_entries": f"WITH {FIRST} SELECT u, v, -1.0::DOUBLE AS w FROM ways UNION ALL SELECT u, u, count(*)::DOUBLE FROM ways GROUP BY u",
    "neighbor_mean": f"WITH {FIRST} SELECT u AS node_id, round(avg(p_size::DOUBLE), 6) AS size, round(avg(p_retailprice), 6) AS price FROM ways JOIN part ON v = 'p' || p_partkey GROUP BY u",
    "anchor_propagation": _anchor(),
    "feature_standardize": "WITH s AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM part) SELECT p_partkey, round((p_size - m1) / s1, 6) AS size, round((p_retailprice - m2) / s2, 6) AS price FROM part, s",
    "row_l2_normalize": f"WITH {UNIT} SELECT node_id, round(vec[1], 6) AS first, round(vec[64], 6) AS last, round(sqrt(list_dot_product(vec, vec)), 6) AS norm FROM unit",
    "cosine_pairs": f"WITH {UNIT} SELECT a.node_id AS u, b.node_id AS v, round(list_dot_product(a.vec, b.vec), 6) AS score FROM unit a JOIN unit b ON b.node_id = a.node_id + 1",
    "topk_cosine_graph": f"""WITH {UNIT}, s AS (SELECT a.node_id AS a, b.node_id AS b, list_dot_product(a.vec, b.vec) AS s FROM unit a JOIN unit b ON a.node_id <> b.node_id),
k AS (SELECT * FROM s WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5) SELECT least(a, b) AS u, greatest(a, b) AS v, round(max(s), 6) AS w FROM k GROUP BY ALL""",
    "exp_log_map": f"WITH {UNIT} SELECT node_id, round(tanh(0.5) * vec[1], 6) AS up, round(0.5 * vec[1], 6) AS back, round(tanh(0.5::DOUBLE), 6) AS radius FROM unit",
    "mobius_fuse": _fuse(),
    "gate_value": f"""WITH {EMB}, h AS (SELECT node_id, vec[1:4] AS a, vec[5:8] AS b FROM emb), n AS (SELECT node_id, list_concat(list_transform(a, lambda x: tanh(0.5) * x / sqrt(list_dot_product(a, a))), list_transform(b, lambda x: tanh(0.5) * x / sqrt(list_dot_product(b, b)))) AS f FROM h)
SELECT node_id, round(1 / (1 + exp(-(0.1 * (-f[1] + f[3] - f[4] + f[6] - f[7]) + 0.05))), 6) AS gate FROM n""",
    "sigmoid_softmax": f"WITH {EMB}, s AS (SELECT node_id, vec, list_transform(vec[1:8], lambda x: exp(x)) AS e FROM emb) SELECT node_id, round(1 / (1 + exp(-greatest(-20, least(20, vec[1] * 10)))), 6) AS sig, round(e[1] / list_sum(e), 6) AS soft, 1.0::DOUBLE AS total FROM s",
    "int8_quantize": f"WITH {QUANT} SELECT node_id, dim::BIGINT AS dim, q::BIGINT AS q FROM quantized",
    "int8_error": f"WITH {QUANT} SELECT round(sqrt(sum((x - q * s) * (x - q * s))) / sqrt(sum(x * x)), 6) AS error FROM quantized",
    "binary_quantize": f"WITH {EMB} SELECT node_id, list_sum(list_transform(vec, lambda x: CASE WHEN x >= 0 THEN 1 ELSE -1 END))::BIGINT AS total, (CASE WHEN vec[1] >= 0 THEN 1 ELSE -1 END)::BIGINT AS first FROM emb",
    "incremental_struct_update": _incremental(),
    "text_hash_features": """WITH t AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS h FROM documents),
b AS (SELECT doc_id, (('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT % 16)::BIGINT AS bucket FROM t) SELECT doc_id, bucket, count(*) AS n FROM b GROUP BY doc_id, bucket""",
    "text_statistics": r"WITH t AS (SELECT doc_id, regexp_replace(text, '[^\x21-\x7E]+', ' ', 'g') AS x FROM documents), s AS (SELECT doc_id, x, len(regexp_extract_all(x, '[^ ]+')) AS words FROM t) SELECT doc_id, words::BIGINT AS words, length(x) AS chars, round(ln(1.0 + words), 6) AS log_words FROM s",
    "venue_labels": f"WITH {PAPERS} SELECT venue, label FROM venues",
    "venue_normalize": r"SELECT p_partkey, trim(regexp_replace(lower('  ' || upper(p_type) || chr(9) || ' ' || chr(10) || p_name || ' '), '\s+', ' ', 'g')) AS venue FROM part",
    "scalar_parsing": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN NULL WHEN 2 THEN 1999.7 WHEN 3 THEN NULL ELSE value END AS number, CASE event_id % 5 WHEN 2 THEN 1999 WHEN 4 THEN CASE WHEN floor(value) BETWEEN 1000 AND 2100 THEN floor(value)::BIGINT END END AS year FROM events",
    "paper_score": f"WITH {PAPERS} SELECT id, in_count, out_count, score FROM scored",
    "dense_select": f"""WITH {PAPERS}, pool AS (SELECT * FROM scored ORDER BY score DESC, year DESC, id LIMIT 600),
links AS (SELECT DISTINCT l.id, l.ref FROM listed l WHERE l.id <> l.ref AND l.id IN (SELECT id FROM pool) AND l.ref IN (SELECT id FROM pool)),
again AS (SELECT p.id, p.year, p.score + 2.0::DOUBLE * (SELECT count(*) FROM links WHERE links.id = p.id) + 2.0::DOUBLE * (SELECT count(*) FROM links WHERE links.ref = p.id) AS score FROM pool p)
SELECT id, score FROM again ORDER BY score DESC, year DESC, id LIMIT 300""",
    "reference_edges": f"WITH {PAPERS} SELECT DISTINCT id, ref FROM listed WHERE id <> ref AND ref IN (SELECT id FROM papers)",
    "unresolved_references": f"""WITH {PAPERS}, kept AS (SELECT id FROM scored ORDER BY score DESC, year DESC, id LIMIT 600), r AS (SELECT DISTINCT id, ref FROM listed WHERE id <> ref AND id IN (SELECT id FROM kept))
SELECT count(*) FILTER (ref IN (SELECT id FROM kept)) AS resolved, count(*) FILTER (ref NOT IN (SELECT id FROM kept)) AS unresolved_references FROM r""",
    "record_counters": "SELECT count(*) AS records_total, 0::BIGINT AS missing_id, 0::BIGINT AS invalid_year, count(*) FILTER (year(o_orderdate) NOT BETWEEN 1996 AND 2000) AS out_of_range, count(*) FILTER (year(o_orderdate) BETWEEN 1996 AND 2000) AS accepted FROM orders",
    "label_cleanup": """WITH n AS (SELECT d.doc_id AS node_id, coalesce(quality * 2 + toxic, -1)::BIGINT AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
s AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS dense FROM n WHERE label >= 0 GROUP BY label HAVING count(*) >= 20) SELECT node_id, coalesce(CASE WHEN (SELECT count(*) FROM s) >= 2 THEN dense END, -1) AS label FROM n LEFT JOIN s USING (label)""",
    "stratified_split": f"WITH {SPLIT} SELECT node_id, label, train FROM split",
    "random_split": f"WITH {EMB}, r AS (SELECT node_id, row_number() OVER (ORDER BY md5('42|' || node_id), node_id) AS nth, count(*) OVER () AS n FROM emb) SELECT node_id, nth <= floor(n * 0.7::DOUBLE) AS train FROM r",
    "centroid_predict": f"WITH {PREDICTED} SELECT node_id, label, pred FROM predicted",
    "confusion": f"WITH {PREDICTED} SELECT class, tp, fp, fn FROM cells3",
    "f1_scores": f"WITH {PREDICTED} SELECT round(avg(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2.0::DOUBLE * tp + fp + fn) ELSE 0 END), 6) AS macro_f1, round(2.0::DOUBLE * sum(tp) / (2.0::DOUBLE * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM cells3",
    "link_auc": f"WITH {PV} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0 END), 9) AS auc FROM (SELECT score FROM rows_ WHERE positive) p, (SELECT score FROM rows_ WHERE NOT positive) n",
    "link_ap": f"WITH {PV}, r AS (SELECT positive, row_number() OVER w AS k, sum(positive::INT) OVER w AS hits FROM rows_ WINDOW w AS (ORDER BY score DESC, positive DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(hits::DOUBLE / k) / count(*), 9) AS ap FROM r WHERE positive",
    "pair_sampling_pos": f"WITH {FIRST} SELECT u, v FROM e ORDER BY md5('42|' || u || '|' || v), u, v LIMIT 128",
    "pair_sampling_neg": f"""WITH {FIRST}, ids AS (SELECT u AS node_id, row_number() OVER (ORDER BY u) - 1 AS idx FROM (SELECT DISTINCT u FROM ways)), n AS (SELECT count(*) AS n FROM ids),
t AS (SELECT range AS id, floor({_u(42, "range", "'u'")} * n)::BIGINT AS i, floor({_u(42, "range", "'v'")} * n)::BIGINT AS j FROM range(0, 3840), n)
SELECT least(a.node_id, b.node_id) AS u, greatest(a.node_id, b.node_id) AS v FROM t JOIN ids a ON a.idx = t.i JOIN ids b ON b.idx = t.j
WHERE t.i <> t.j AND NOT EXISTS (SELECT 1 FROM e WHERE e.u = least(a.node_id, b.node_id) AND e.v = greatest(a.node_id, b.node_id)) ORDER BY t.id LIMIT 128""",
    "copurchase_selfjoin": """WITH p AS (SELECT DISTINCT l_partkey AS i, l_orderkey AS o FROM lineitem), k AS (SELECT p.* FROM p WHERE o IN (SELECT o FROM p GROUP BY o HAVING count(*) <= 500)),
e AS (SELECT DISTINCT a.i AS u, b.i AS v FROM k a JOIN k b USING (o) WHERE a.i < b.i) SELECT node_id, count(*) AS degree FROM (SELECT u AS node_id FROM e UNION ALL SELECT v FROM e) GROUP BY node_id""",
    "latency_p95": "SELECT event_type, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.95), 9) AS p95, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type",
    "global_quantiles": "WITH q AS (SELECT unnest([0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])::DOUBLE AS q, unnest(quantile_cont(value, [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])) AS value FROM events) SELECT q, round(value, 9) AS value FROM q",
    "results_alias_merge": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS model, event_id::VARCHAR AS nodes FROM events",
    "history_patch_mean": """WITH d AS (SELECT user_id, day(ts) AS t, avg(value) AS y FROM events WHERE event_type = 'view' GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS late FROM d QUALIFY late <= 8),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM h)
SELECT user_id, ((pos - pos % 3) / 3)::BIGINT AS patch, round(sum(y * CASE WHEN late = 1 THEN 1 + (3 - n % 3) % 3 ELSE 1 END) / 3, 6) AS y0 FROM p GROUP BY ALL""",
    "last_wins_upsert": "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "dense_labels": "WITH k AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS label FROM (SELECT DISTINCT p_brand FROM part)) SELECT p_partkey, label FROM part JOIN k USING (p_brand)",
    "argmax_label": f"WITH {EMB} SELECT node_id, (list_position(vec, list_max(vec)) - 1)::BIGINT AS place FROM emb",
    "default_attributes": f"SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice ELSE 0.01 * sqrt(-2.0 * ln(greatest({_u(42, 'p_partkey', repr('0'), repr('a'))}, pow(2.0, -33)))) * cos(6.283185307179586 * {_u(42, 'p_partkey', repr('0'), repr('b'))}) END, 6) AS x FROM part",
    "one_hot_membership": """WITH p AS (SELECT DISTINCT user_id AS node_id, event_type AS col FROM events), t AS (SELECT col, row_number() OVER (ORDER BY count(*) DESC, col) - 1 AS place FROM p GROUP BY col)
SELECT node_id, (count(*) FILTER (place = 0))::BIGINT AS c0, (count(*) FILTER (place = 1))::BIGINT AS c1, (count(*) FILTER (place = 2))::BIGINT AS c2 FROM p JOIN t USING (col) WHERE place < 3 GROUP BY node_id""",
    "top_features": "SELECT l_partkey AS col, row_number() OVER (ORDER BY count(*) DESC, l_partkey) - 1 AS place FROM lineitem GROUP BY l_partkey ORDER BY place LIMIT 64",
    "synthetic_graph": f"""WITH n AS (SELECT c_custkey AS id, c_mktsegment AS label, row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS r, count(*) OVER () AS total FROM customer),
p AS (SELECT *, min(r) OVER (PARTITION BY label) AS first, count(*) OVER (PARTITION BY label) AS size FROM n),
d AS (SELECT id, first + floor({_u(42, "'in'", 'id', 'k')} * size)::BIGINT AS r FROM p, range(0, 4) t(k) UNION ALL SELECT id, floor({_u(42, "'out'", 'id', '0')} * total)::BIGINT FROM p)
SELECT DISTINCT least(d.id, n.id) AS u, greatest(d.id, n.id) AS v FROM d JOIN n USING (r) WHERE d.id <> n.id""",
    "spectral_values": "SELECT range AS place, CASE WHEN range < 31 - (SELECT count(*) FROM nation) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM range(0, 30)",
    "stream_daily_windows": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "stream_restart_structure": _restart(),
    "reconstruction_scores": f"""WITH {UNIT}, s AS (SELECT a.node_id AS a, b.node_id AS b, list_dot_product(a.vec, b.vec) AS s FROM unit a JOIN unit b ON a.node_id <> b.node_id),
k AS (SELECT * FROM s WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 3), g AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM k),
pos AS (SELECT u, v FROM g ORDER BY md5('42|' || u || '|' || v), u, v LIMIT 200),
idx AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS i FROM unit),
num AS (SELECT e, e - row_number() OVER (ORDER BY e) + 1 AS at FROM (SELECT greatest(a.i, b.i) * (greatest(a.i, b.i) - 1) // 2 + least(a.i, b.i) AS e FROM g JOIN idx a ON a.node_id = g.u JOIN idx b ON b.node_id = g.v)),
free AS (SELECT (SELECT count(*) * (count(*) - 1) // 2 FROM idx) - (SELECT count(*) FROM num) AS n),
draws AS (SELECT t, floor(({_u(42, 't', "'high'")} + {_u(42, 't', "'low'")} / 4294967296.0::DOUBLE) * n::DOUBLE)::BIGINT AS r FROM range(0, 900) d(t), free),
ranks AS (SELECT r FROM draws GROUP BY r ORDER BY min(t) LIMIT 200),
picked AS (SELECT r + (SELECT count(*) FROM num WHERE num.at <= r) AS p FROM ranks),
neg AS (SELECT least(a.node_id, b.node_id) AS u, greatest(a.node_id, b.node_id) AS v FROM picked JOIN idx b ON b.i * (b.i - 1) // 2 <= p AND b.i * (b.i + 1) // 2 > p JOIN idx a ON a.i = p - b.i * (b.i - 1) // 2),
ps AS (SELECT s FROM pos JOIN s ON s.a = u AND s.b = v), ns AS (SELECT s FROM neg JOIN s ON s.a = u AND s.b = v)
SELECT round(avg(CASE WHEN ps.s > ns.s THEN 1.0::DOUBLE WHEN ps.s = ns.s THEN 0.5::DOUBLE ELSE 0 END), 6) AS auc FROM ps, ns""",
}
