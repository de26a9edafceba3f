"""The catalogue's queries in SQL, for another engine to check them by."""

from __future__ import annotations

from strandlake.functions import classes
from strandlake.operators.hierarchy import RESOLUTIONS

_LINES = "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem"
SIG = f"""lines AS ({_LINES}),
dom AS (SELECT DISTINCT l_orderkey AS id, CAST(l_partkey AS VARCHAR) AS f FROM lines),
nxt AS (SELECT l_orderkey AS id, l_partkey AS p, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS q FROM lines),
prs AS (SELECT DISTINCT id, CAST(least(p, q) AS VARCHAR) || '_' || CAST(greatest(p, q) AS VARCHAR) AS f FROM nxt WHERE q IS NOT NULL),
sig AS (SELECT id, 'd' AS kind, f FROM dom UNION ALL SELECT id, 'p', f FROM prs),
siz AS (SELECT id, count(*) FILTER (kind = 'd') AS nd, count(*) FILTER (kind = 'p') AS np FROM sig GROUP BY id)"""
_SCORE = """0.5 * CASE WHEN a.nd + b.nd > 0 THEN 2.0 * sd / (a.nd + b.nd) ELSE 0 END + 0.5 * CASE WHEN a.np + b.np > 0 THEN 2.0 * sp / (a.np + b.np) ELSE 0 END"""
_SCORE = _SCORE.replace("2.0", "2.0::DOUBLE").replace("0.5 *", "0.5::DOUBLE *")


def _composite(left: str, right: str, cond: str = "true") -> str:
    return f"""SELECT i, j, {_SCORE} AS s FROM (
 SELECT x.id AS i, y.id AS j, count(*) FILTER (x.kind = 'd') AS sd, count(*) FILTER (x.kind = 'p') AS sp
 FROM {left} x JOIN {right} y ON x.kind = y.kind AND x.f = y.f WHERE {cond} GROUP BY 1, 2) m JOIN siz a ON a.id = i JOIN siz b ON b.id = j"""


SIM = f"{SIG}, sim AS (SELECT * FROM ({_composite('sig', 'sig', 'x.id < y.id')}) WHERE s >= 0.05), both_ways AS (SELECT i, j, s FROM sim UNION ALL SELECT j, i, s FROM sim)"
ENT = "ent AS (SELECT o_orderkey AS id, o_orderstatus = 'P' AS is_partial, o_orderpriority = '1-URGENT' AS is_validated FROM orders)"
LEV = """lev AS (SELECT o_orderkey AS id, CAST(n_regionkey AS VARCHAR) AS l0, CAST(n_nationkey AS VARCHAR) AS l1, CAST(n_nationkey AS VARCHAR) || '/' || c_mktsegment AS l2
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
PTH = f"""{LEV},
r0 AS (SELECT l0, CAST(row_number() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS VARCHAR) AS s0 FROM lev GROUP BY l0),
r1 AS (SELECT l0, l1, CAST(row_number() OVER (PARTITION BY l0 ORDER BY count(*) DESC, min(id)) - 1 AS VARCHAR) AS s1 FROM lev GROUP BY l0, l1),
r2 AS (SELECT l0, l1, l2, CAST(row_number() OVER (PARTITION BY l0, l1 ORDER BY count(*) DESC, min(id)) - 1 AS VARCHAR) AS s2 FROM lev GROUP BY l0, l1, l2),
pth AS (SELECT id, s0 AS path_0, s0 || '.' || s1 AS path_1, s0 || '.' || s1 || '.' || s2 AS path_2 FROM lev JOIN r0 USING (l0) JOIN r1 USING (l0, l1) JOIN r2 USING (l0, l1, l2)),
mem AS (SELECT id, 0 AS level, path_0 AS path, NULL::VARCHAR AS parent FROM pth UNION ALL SELECT id, 1, path_1, path_0 FROM pth UNION ALL SELECT id, 2, path_2, path_1 FROM pth)"""
PLC = f"{LEV}, plc AS (SELECT id, l2 AS path, (id % 401) / 20.0::DOUBLE - 10 AS x, ((id * 7) % 401) / 20.0::DOUBLE - 10 AS y FROM lev)"

ANN = """ann AS (SELECT user_id AS sample, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 2 AS BIGINT) AS orf_idx, least(value / 500, 1.0::DOUBLE) AS score FROM events),
cnt AS (SELECT sample, max(orf_idx) + 1 AS n FROM ann GROUP BY sample),
orf AS (SELECT sample, i AS orf_idx, i * 1000 AS s, i * 1000 + 900 AS e FROM (SELECT sample, unnest(range(0, n + 1)) AS i FROM cnt)),
tru AS (SELECT sample, ((n + 1) // 3) * 1000 AS s, 2 * ((n + 1) // 3) * 1000 AS e FROM cnt),
cds AS (SELECT o.sample, 'orf' || CAST(orf_idx AS VARCHAR) AS tag, o.s, o.e, o.s < t.e AND o.e > t.s AS in_gt FROM orf o JOIN tru t USING (sample)),
sco AS (SELECT o.sample, o.orf_idx, o.s, o.e, greatest(coalesce(max(score), 0), 0) AS score FROM orf o LEFT JOIN ann a USING (sample, orf_idx) GROUP BY ALL)"""
ISL = f"{ANN}, isl AS (SELECT sample, orf_idx, s, e, orf_idx - row_number() OVER (PARTITION BY sample ORDER BY orf_idx) AS g FROM sco WHERE score >= 0.3), prd AS (SELECT sample, min(s) AS s, max(e) AS e FROM isl GROUP BY sample, g)"


def _f(p: str, r: str, beta: float) -> str:
    b = beta * beta
    return f"CASE WHEN {b}::DOUBLE * {p} + {r} > 0 THEN (1 + {b}::DOUBLE) * {p} * {r} / ({b}::DOUBLE * {p} + {r}) ELSE 0::DOUBLE END"


def _fs(p: str, r: str, name: str) -> str:
    return ", ".join(f"round({_f(p, r, b)}, 9) AS {name}_{n}" for n, b in (("f1", 1.0), ("f2", 2.0), ("f05", 0.5)))


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0::DOUBLE END"


_HIT = "EXISTS (SELECT 1 FROM {0} o WHERE {1} p.s < o.e AND p.e > o.s)"


def _eval(keys: str, samples: str, prd: str, tru: str, cds: str, eq: str) -> str:
    """Common tables ce and oe: the counts of each sample (and threshold)."""
    k = keys
    return f"""pf AS (SELECT {k}, count(*) AS np, count(*) FILTER ({_HIT.format(tru, eq)}) AS tp FROM {prd} p GROUP BY {k}),
tf AS (SELECT {k}, count(*) AS nt, count(*) FILTER ({_HIT.format(prd, eq)}) AS hit FROM {tru} p GROUP BY {k}),
gc AS (SELECT {k}, count(*) AS ng, count(*) FILTER ({_HIT.format(prd, eq)}) AS cov FROM (SELECT * FROM {cds} WHERE in_gt) p GROUP BY {k}),
pr AS (SELECT {', '.join('p.' + x for x in k.split(', '))}, p.s, p.e, count(o.tag) AS n, count(*) FILTER (o.in_gt) AS c FROM {prd} p LEFT JOIN {cds} o ON {eq} p.s < o.e AND p.e > o.s GROUP BY ALL),
pa AS (SELECT {k}, CAST(sum(n) AS BIGINT) AS npc, CAST(sum(c) AS BIGINT) AS cpc, avg(CAST({_ratio('c', 'n')} AS DECIMAL(28, 12)))::DOUBLE AS ap FROM pr GROUP BY {k}),
ev AS (SELECT {k}, coalesce(tp, 0) AS cluster_tp, coalesce(np, 0) - coalesce(tp, 0) AS cluster_fp, coalesce(nt, 0) - coalesce(hit, 0) AS cluster_fn, coalesce(ng, 0) AS orf_n_gt_cds, coalesce(cov, 0) AS orf_covered_cds,
 coalesce(npc, 0) AS orf_n_pred_cds, coalesce(cpc, 0) AS orf_correct_pred_cds, coalesce(ap, 0)::DOUBLE AS orf_avg_precision_t FROM {samples} LEFT JOIN pf USING ({k}) LEFT JOIN tf USING ({k}) LEFT JOIN gc USING ({k}) LEFT JOIN pa USING ({k})),
ex AS (SELECT *, {_ratio('cluster_tp', 'cluster_tp + cluster_fp')} AS cp, {_ratio('cluster_tp', 'cluster_tp + cluster_fn')} AS cr, {_ratio('orf_covered_cds', 'orf_n_gt_cds')} AS rt FROM ev)"""


EVL = f"{ISL}, smp AS (SELECT DISTINCT user_id AS sample FROM events), " + _eval("sample", "smp", "prd", "tru", "cds", "p.sample = o.sample AND")
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in "cluster_tp cluster_fp cluster_fn orf_n_gt_cds orf_covered_cds orf_n_pred_cds orf_correct_pred_cds".split())
_COUNTS = "cluster_tp, cluster_fp, cluster_fn, orf_n_gt_cds, orf_covered_cds, orf_n_pred_cds, orf_correct_pred_cds"
_RATIOS = f"{_ratio('cluster_tp', 'cluster_tp + cluster_fp')} AS cp, {_ratio('cluster_tp', 'cluster_tp + cluster_fn')} AS cr, {_ratio('orf_correct_pred_cds', 'orf_n_pred_cds')} AS op, {_ratio('orf_covered_cds', 'orf_n_gt_cds')} AS orr"
SWP = f"""{ANN}, thr AS (SELECT i::DOUBLE * 0.005::DOUBLE AS threshold FROM range(0, 201) t(i)), smp AS (SELECT threshold, sample FROM (SELECT DISTINCT user_id AS sample FROM events) CROSS JOIN thr),
isl AS (SELECT threshold, sample, orf_idx, s, e, orf_idx - row_number() OVER (PARTITION BY threshold, sample ORDER BY orf_idx) AS g FROM sco JOIN thr ON score >= threshold),
prd AS (SELECT threshold, sample, min(s) AS s, max(e) AS e FROM isl GROUP BY threshold, sample, g), trt AS (SELECT threshold, tru.* FROM tru CROSS JOIN thr), cdt AS (SELECT threshold, cds.* FROM cds CROSS JOIN thr),
{_eval('threshold, sample', 'smp', 'prd', 'trt', 'cdt', 'p.threshold = o.threshold AND p.sample = o.sample AND')},
swp AS (SELECT *, {_RATIOS} FROM (SELECT threshold, {_SUMS} FROM ev GROUP BY threshold))"""
RAT = "rat AS (SELECT doc_id, least(n_chars / 5000::DOUBLE, 1.0::DOUBLE) AS score, quality AS target FROM documents JOIN labels USING (doc_id))"
PRC = f"""{RAT}, att AS (SELECT score, CAST(sum(target) AS BIGINT) AS h, count(*) AS n FROM rat GROUP BY score),
prc AS (SELECT score, sum(h) OVER w / sum(n) OVER w AS p, CASE WHEN sum(h) OVER () > 0 THEN sum(h) OVER w / sum(h) OVER () ELSE 0 END AS r FROM att WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
LGT = f"""{RAT}, lgt AS (SELECT doc_id, score * 6 - 3 AS x, target::DOUBLE AS y, doc_id % 3 <> 0 AS kept FROM rat),
fcl AS (SELECT *, greatest(x, 0) - x * y + ln(1 + exp(-abs(x))) AS bce, (1 / (1 + exp(-x))) * y + (1 - 1 / (1 + exp(-x))) * (1 - y) AS pt FROM lgt)"""

ONT = """lnk AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS child, 'B:' || p_brand AS parent FROM part UNION SELECT 'P' || CAST(p_partkey AS VARCHAR), 'T:' || p_type FROM part
 UNION SELECT DISTINCT 'B:' || p_brand, 'ROOT' FROM part UNION SELECT DISTINCT 'T:' || p_type, 'ROOT' FROM part),
trm AS (SELECT child AS id FROM lnk UNION SELECT parent FROM lnk),
rec AS (SELECT id AS term, id AS ancestor, 0 AS dist FROM trm UNION ALL SELECT r.term, l.parent, r.dist + 1 FROM rec r JOIN lnk l ON l.child = r.ancestor WHERE r.dist < 64),
clo AS (SELECT term, ancestor, min(dist) AS dist FROM rec GROUP BY 1, 2)"""
ICV = f"""{ONT}, tcn AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) AS term, count(*) AS cnt FROM lineitem GROUP BY 1), tot AS (SELECT count(*) AS n FROM lineitem),
icv AS (SELECT ancestor AS term, -log2(least(sum(cnt)::DOUBLE / (SELECT n FROM tot), 1.0)) + 0.0 AS ic FROM tcn JOIN clo USING (term) GROUP BY 1)"""
LIN = f"""{ICV}, cmp AS (SELECT * FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL),
st AS (SELECT DISTINCT l_orderkey AS entity, 'P' || CAST(l_partkey AS VARCHAR) AS term FROM lineitem),
one AS (SELECT a, b, x.term AS t1, y.term AS t2 FROM cmp JOIN st x ON x.entity = a JOIN st y ON y.entity = b),
tps AS (SELECT t1, t2 FROM one UNION SELECT t2, t1 FROM one),
mic AS (SELECT t1, t2, max(ic) AS best FROM tps JOIN clo c1 ON c1.term = t1 JOIN clo c2 ON c2.term = t2 AND c2.ancestor = c1.ancestor JOIN icv ON icv.term = c1.ancestor GROUP BY 1, 2),
res AS (SELECT t1, t2, coalesce(CASE WHEN t1 = t2 THEN i1.ic ELSE best END, 0) AS resnik, coalesce(i1.ic, 0) + coalesce(i2.ic, 0) AS tot FROM tps LEFT JOIN mic USING (t1, t2) LEFT JOIN icv i1 ON i1.term = t1 LEFT JOIN icv i2 ON i2.term = t2),
lin AS (SELECT t1, t2, CASE WHEN tot > 0 THEN least(2 * resnik / tot, 1.0) ELSE 0 END AS lin, resnik FROM res)"""


def _bma(value: str) -> str:
    return f"""{LIN}, bst AS (SELECT a, b, t1 AS t, 0 AS side, max({value}) AS v FROM one JOIN lin USING (t1, t2) GROUP BY 1, 2, 3 UNION ALL
 SELECT a, b, one.t2, 1, max({value}) FROM one JOIN lin ON lin.t1 = one.t2 AND lin.t2 = one.t1 GROUP BY 1, 2, 3),
bma AS (SELECT a, b, avg(CAST(v AS DECIMAL(28, 14)))::DOUBLE AS score FROM bst GROUP BY 1, 2)"""


def _list(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


def _map(table: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in table.items())}}}"


def _classes() -> str:
    names = [t for types in classes.PRODUCT_TYPES.values() for t in types]
    n = len(names)
    pick = lambda e: f"names[CAST(({e}) % {n} + 1 AS INT)]"
    clean = "trim(regexp_replace(replace(lower(raw), '-', '_'), '_+', '_', 'g'), '_')"
    return f"""prd AS (SELECT id, tool, raw, lower(trim(tool)) LIKE 'antismash%' AS is_anti, {clean} AS c FROM (
 SELECT l_orderkey AS id, {_list(['antiSMASH:8.0.1', 'GECCO v0.9.8', 'SanntiSv0.9.3.3', 'mibig:4.0'])}[l_linenumber % 4 + 1] AS tool,
 CASE WHEN l_linenumber % 4 = 0 THEN {pick('l_partkey')} || '_' || {pick('l_partkey * 7 + 3')} ELSE {_list(['Polyketide', 'NRP_Other', '', 'Unknown', 'Alkaloid_Terpene', 'Made-up'])}[CAST(l_partkey % 6 + 1 AS INT)] END AS raw
 FROM ({_LINES}), (SELECT {_list(names)} AS names))),
cat AS (SELECT id, tool, raw, CASE WHEN trim(raw) = '' THEN [] WHEN is_anti THEN list_distinct(list_transform(regexp_extract_all(c, '{classes.tokens_pattern()}', 1), lambda t: coalesce({_map(classes.product_classes())}[t], 'Other')))
 ELSE list_distinct(list_transform(list_filter(string_split(c, '_'), lambda t: t <> ''), lambda t: coalesce({_map(classes.BASE_NAMES)}[t], 'Other'))) END AS cs FROM prd)"""


def _label(c: str) -> str:
    real = f"list_filter({c}, lambda x: x <> 'Other')"
    return f"CASE WHEN len({c}) = 0 THEN '' WHEN len({real}) = 0 THEN 'Other' WHEN list_contains({c}, 'Polyketide') AND list_contains({c}, 'NRP') THEN 'Hybrid(P+N)' WHEN len({real}) = 1 THEN ({real})[1] ELSE 'Hybrid' END"


CTG = "ctg AS (SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS id, text AS seq FROM documents), pas AS (SELECT DISTINCT id FROM ctg WHERE length(seq) >= 1000)"
GFF = """gff AS (SELECT doc_id AS line_no, CASE WHEN doc_id % 11 = 0 THEN '# ' || sid ELSE concat_ws(chr(9), sid, 'tool', ['BGC', 'bgc', 'gene'][doc_id % 3 + 1], CAST(doc_id % 50 + 1 AS VARCHAR), CAST(doc_id % 50 + 500 AS VARCHAR), '.', '+', '.', 'ID=r' || CAST(doc_id AS VARCHAR)) END AS raw
 FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'gone' ELSE CAST(doc_id AS VARCHAR) END AS sid FROM labels)),
reg AS (SELECT line_no, c[1] AS seqid, CAST(c[4] AS BIGINT) - 1 AS s, CAST(c[5] AS BIGINT) AS e, c[9] AS attributes, row_number() OVER (ORDER BY line_no) AS idx
 FROM (SELECT line_no, string_split(raw, chr(9)) AS c FROM gff WHERE raw NOT LIKE '#%') WHERE len(c) >= 9 AND lower(c[3]) = 'bgc')"""
PRO = """pro AS (SELECT CAST(label AS VARCHAR) AS bgc, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS k FROM embeddings)"""
PEN = f"""{PRO}, pe AS (SELECT bgc, pos, k, x + 0.5 * CASE WHEN k % 2 = 0 THEN sin(pos / pow(10000.0, 2.0 * (k // 2) / 64)) ELSE cos(pos / pow(10000.0, 2.0 * (k // 2) / 64)) END AS x FROM pro),
nrm AS (SELECT bgc, pos, sqrt(sum(x * x)) AS n FROM pe GROUP BY 1, 2), pol AS (SELECT bgc, k, avg(CASE WHEN n > 0 THEN x / n ELSE x END) AS x, count(*) AS n FROM pe JOIN nrm USING (bgc, pos) GROUP BY 1, 2),
pon AS (SELECT bgc, sqrt(sum(x * x)) AS m FROM pol GROUP BY 1)"""
_BEST = "best AS (SELECT i AS id, max(s) AS best FROM {0} GROUP BY 1)"
_NOVEL = "SELECT id, round(CASE WHEN NOT (SELECT bool_or(is_validated) FROM ent) THEN NULL WHEN is_validated THEN 0 ELSE 1.0::DOUBLE - coalesce(best, 0) END, 9) AS novelty FROM ent LEFT JOIN best USING (id)"


def statements() -> dict[str, str]:
    q = {
        "dice_topk": f"WITH {SIM} SELECT i, j, round(s, 9) AS s, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rank FROM both_ways) WHERE rank <= 5",
        "composite_dice_stats": f"WITH {SIM} SELECT CAST(floor(s * 10) AS BIGINT) AS tenth, count(*) AS n, round(sum(CAST(s AS DECIMAL(28, 12)))::DOUBLE, 6) AS total, round(max(s), 6) AS most FROM sim GROUP BY 1",
        "knn_edges": f"WITH {SIM} SELECT least(i, j) AS a, greatest(i, j) AS b, round(max(s), 9) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rank FROM both_ways) WHERE rank <= 5 GROUP BY 1, 2",
        "novelty_validated": f"WITH {SIG}, {ENT}, val AS (SELECT sig.* FROM sig JOIN ent USING (id) WHERE is_validated), met AS ({_composite('sig', 'val')}), {_BEST.format('met')} {_NOVEL}",
        "novelty_pruned": f"WITH {SIM}, {ENT}, met AS (SELECT i, s FROM both_ways JOIN ent ON ent.id = j WHERE is_validated), {_BEST.format('met')} {_NOVEL}",
        "domain_novelty": f"""WITH {SIG}, {LEV}, leaf AS (SELECT id, l2 AS path, count(*) OVER (PARTITION BY l2) AS n FROM lev),
 hld AS (SELECT id, count(*) OVER (PARTITION BY path, f) AS c FROM leaf JOIN dom USING (id) WHERE n > 1)
 SELECT id, round(share, 9) AS domain_novelty FROM lev LEFT JOIN (SELECT id, sum((c = 1)::INT)::DOUBLE / count(*) AS share FROM hld GROUP BY id) USING (id)""",
        "project_partials": f"""WITH {SIG}, {ENT}, {PLC}, sq AS (SELECT sig.* FROM sig JOIN ent USING (id) WHERE is_partial), sp AS (SELECT sig.* FROM sig JOIN ent USING (id) WHERE NOT is_partial),
 met AS (SELECT * FROM ({_composite('sq', 'sp')}) WHERE s > 0),
 ner AS (SELECT m.*, path, x, y FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rank FROM met) m JOIN plc ON plc.id = j WHERE rank <= 10),
 cen AS (SELECT i, sum(CAST(s AS DECIMAL(28, 12))) AS t, sum(CAST(s * x AS DECIMAL(28, 12))) AS sx, sum(CAST(s * y AS DECIMAL(28, 12))) AS sy FROM ner GROUP BY i HAVING sum(CAST(s AS DECIMAL(28, 12))) >= 0.1),
 vot AS (SELECT i, path, row_number() OVER (PARTITION BY i ORDER BY sum(CAST(s AS DECIMAL(28, 12))) DESC, min(rank)) AS place FROM ner GROUP BY i, path),
 lef AS (SELECT i, path FROM vot WHERE place = 1), bst AS (SELECT i, max(s) AS best FROM met JOIN ent ON ent.id = j WHERE is_validated GROUP BY i),
 knw AS (SELECT DISTINCT path, f FROM sp JOIN plc USING (id) WHERE kind = 'd'),
 own AS (SELECT i, count(*) FILTER (knw.f IS NULL)::DOUBLE / count(*) AS dn FROM lef JOIN sq ON sq.id = i AND kind = 'd' LEFT JOIN knw ON knw.path = lef.path AND knw.f = sq.f GROUP BY i)
 SELECT i AS id, path AS leaf_path, round(sx::DOUBLE / t::DOUBLE, 6) AS x, round(sy::DOUBLE / t::DOUBLE, 6) AS y, round(CASE WHEN is_validated THEN 0 ELSE 1.0::DOUBLE - coalesce(best, 0) END, 6) AS novelty, round(dn, 6) AS domain_novelty
 FROM cen JOIN lef USING (i) JOIN ent ON ent.id = i LEFT JOIN bst USING (i) LEFT JOIN own USING (i)""",
        "ltree_paths": f"WITH {PTH} SELECT * FROM pth",
        "gcf_nodes": f"""WITH {PTH}, nod AS (SELECT path AS family_path, parent AS parent_path, level::BIGINT AS level, count(*) AS member_count FROM mem GROUP BY ALL)
 SELECT n.*, coalesce((SELECT count(*) FROM nod c WHERE c.parent_path = n.family_path), 0) AS descendant_count FROM nod n""",
        "medoids": f"""WITH {SIM}, {PTH}, sums AS (SELECT a.level, a.path, i AS id, sum(CAST(s AS DECIMAL(28, 12))) AS t FROM both_ways JOIN mem a ON a.id = i JOIN mem b ON b.id = j AND b.level = a.level AND b.path = a.path GROUP BY ALL)
 SELECT level::BIGINT AS level, path, id AS medoid FROM (SELECT m.level, m.path, m.id, row_number() OVER (PARTITION BY m.level, m.path ORDER BY coalesce(t, 0) DESC, m.id) AS place FROM mem m LEFT JOIN sums USING (level, path, id)) WHERE place = 1""",
        "layout_normalize": f"""WITH {PLC}, mid AS (SELECT avg(CAST(x AS DECIMAL(28, 12)))::DOUBLE AS mx, avg(CAST(y AS DECIMAL(28, 12)))::DOUBLE AS my FROM plc), cen AS (SELECT id, x - mx AS x, y - my AS y FROM plc, mid)
 SELECT id, round(x * 10 / m, 6) AS x, round(y * 10 / m, 6) AS y FROM cen, (SELECT max(greatest(abs(x), abs(y))) AS m FROM cen)""",
        "per_orf_max": f"WITH {ANN} SELECT sample, orf_idx, s AS start, e AS \"end\", round(score, 9) AS score FROM sco",
        "decode_regions": f"WITH {ISL} SELECT sample, min(orf_idx) AS start, max(orf_idx) + 1 AS \"end\" FROM isl GROUP BY sample, g",
        "decode_regions_nt": f"WITH {ISL} SELECT sample, s AS start, e AS \"end\" FROM prd",
        "cluster_eval": f"WITH {EVL} SELECT sample, cluster_tp, cluster_fp, cluster_fn, round(cp, 9) AS cluster_precision, round(cr, 9) AS cluster_recall, {_fs('cp', 'cr', 'cluster')} FROM ex",
        "orf_eval": f"WITH {EVL} SELECT sample, orf_n_gt_cds, orf_covered_cds, orf_n_pred_cds, orf_correct_pred_cds, round(orf_avg_precision_t, 9) AS orf_avg_precision_t, round(rt, 9) AS orf_avg_recall_t, {_fs('orf_avg_precision_t', 'rt', 'orf')} FROM ex",
        "aggregate_micro": f"WITH {EVL}, m AS (SELECT *, {_RATIOS} FROM (SELECT {_SUMS} FROM ev)) SELECT {_COUNTS}, round(cp, 9) AS cluster_precision, round(cr, 9) AS cluster_recall, round(op, 9) AS orf_precision, round(orr, 9) AS orf_recall, {_fs('cp', 'cr', 'cluster')}, {_fs('op', 'orr', 'orf')} FROM m",
        "aggregate_macro": f"""WITH {EVL}, m AS (SELECT avg(CAST(cp AS DECIMAL(28, 12)))::DOUBLE AS cp, avg(CAST(cr AS DECIMAL(28, 12)))::DOUBLE AS cr, avg(CAST(orf_avg_precision_t AS DECIMAL(28, 12)))::DOUBLE AS op, avg(CAST(rt AS DECIMAL(28, 12)))::DOUBLE AS orr FROM ex)
 SELECT round(cp, 9) AS cluster_precision, round(cr, 9) AS cluster_recall, round(op, 9) AS orf_avg_precision_t, round(orr, 9) AS orf_avg_recall_t, {_fs('cp', 'cr', 'cluster')}, {_fs('op', 'orr', 'orf')} FROM m""",
        "threshold_sweep": f"WITH {SWP} SELECT round(threshold, 9) AS threshold, {_COUNTS}, round(cp, 9) AS cluster_precision, round(cr, 9) AS cluster_recall, round({_f('cp', 'cr', 1.0)}, 9) AS cluster_f1, round(op, 9) AS orf_precision, round(orr, 9) AS orf_recall, round({_f('op', 'orr', 1.0)}, 9) AS orf_f1 FROM swp",
        "sweep_aucpr": f"WITH {SWP} SELECT round(coalesce(sum(CAST(part AS DECIMAL(28, 14))), 0)::DOUBLE, 9) AS aucpr FROM (SELECT (cr - lag(cr) OVER w) * (cp + lag(cp) OVER w) / 2 AS part FROM swp WINDOW w AS (ORDER BY cr, cp DESC, threshold))",
        "pr_curve": f"WITH {PRC} SELECT round(score, 9) AS threshold, round(p, 9) AS precision, round(r, 9) AS recall FROM prc UNION ALL SELECT 1.0, 1.0, 0.0",
        "average_precision": f"WITH {PRC} SELECT round(coalesce(sum(CAST((r - coalesce(pr, 0)) * p AS DECIMAL(28, 14))), 0)::DOUBLE, 9) AS average_precision FROM (SELECT r, p, lag(r) OVER (ORDER BY score DESC) AS pr FROM prc)",
        "focal_loss": f"WITH {LGT} SELECT round(sum(CAST((0.25 * y + 0.75 * (1 - y)) * pow(1 - pt, 2) * bce AS DECIMAL(28, 14)))::DOUBLE / count(*), 8) AS loss FROM fcl",
        "focal_loss_masked": f"WITH {LGT} SELECT round(sum(CAST(pow(1 - pt, 2) * bce * kept::INT AS DECIMAL(28, 14)))::DOUBLE / greatest(sum(kept::INT), 1), 8) AS loss FROM fcl",
        "ontology_depth": f"WITH RECURSIVE {ONT} SELECT id AS term, coalesce((SELECT dist FROM clo WHERE term = id AND ancestor = 'ROOT'), 0)::BIGINT AS depth FROM trm",
        "ontology_ancestors": f"WITH RECURSIVE {ONT} SELECT term, ancestor, dist::BIGINT AS dist FROM clo WHERE dist > 0",
        "ontology_descendants": f"WITH RECURSIVE {ONT} SELECT ancestor AS term, count(*) AS n, max(dist)::BIGINT AS farthest FROM clo WHERE dist > 0 GROUP BY 1",
        "lineage_patterns": f"WITH RECURSIVE {ONT} SELECT term, row_number() OVER (PARTITION BY term ORDER BY dist, length(ancestor), ancestor) AS rank, ancestor, dist::BIGINT AS dist, lower(ancestor) AS smarts FROM clo WHERE NOT starts_with(ancestor, 'T:')",
        "ic_values": f"WITH RECURSIVE {ICV} SELECT term, round(ic, 9) AS ic FROM icv",
        "lin_pairs": f"WITH RECURSIVE {LIN} SELECT t1, t2, round(lin, 9) AS lin FROM lin",
        "semantic_bma": f"WITH RECURSIVE {_bma('lin')} SELECT a, b, round(coalesce(score, 0), 8) AS score FROM cmp LEFT JOIN bma USING (a, b)",
        "resnik_bma": f"WITH RECURSIVE {_bma('resnik')} SELECT a, b, round(least(coalesce(score, 0) / (SELECT max(ic) FROM icv), 1.0), 8) AS score FROM cmp LEFT JOIN bma USING (a, b)",
        "coverage": f"WITH RECURSIVE {LIN}, bst AS (SELECT a, b, t1, max(lin) AS v FROM one JOIN lin USING (t1, t2) GROUP BY 1, 2, 3), cov AS (SELECT a, b, avg(CAST(v AS DECIMAL(28, 14)))::DOUBLE AS score FROM bst GROUP BY 1, 2) SELECT a, b, round(coalesce(score, 0), 8) AS score FROM cmp LEFT JOIN cov USING (a, b)",
        "bgc_class_single": f"WITH {_classes()} SELECT tool, raw, {_label('cs')} AS label, count(*) AS n FROM cat GROUP BY 1, 2, 3",
        "bgc_class_union": f"WITH {_classes()} SELECT id, {_label('cs')} AS label FROM (SELECT id, list_distinct(flatten(list(cs))) AS cs FROM cat GROUP BY id)",
        "tool_family": f"WITH {_classes()} SELECT CASE WHEN lower(tool) LIKE 'antismash%' THEN 'antismash' WHEN lower(tool) LIKE 'gecco%' THEN 'gecco' WHEN lower(tool) LIKE 'sanntis%' THEN 'sanntis' WHEN lower(tool) LIKE 'mibig%' THEN 'mibig' ELSE 'unknown' END AS family, count(*) AS n FROM cat GROUP BY 1",
        "legacy_class_map": f"SELECT raw, coalesce({_map(classes.LEGACY)}[raw], raw) AS label, count(*) AS n FROM (SELECT {_list([*classes.LEGACY, 'NRP', 'nrps'])}[CAST(p_partkey % 9 + 1 AS INT)] AS raw FROM part) GROUP BY 1, 2",
        "contig_filter": f"WITH {CTG} SELECT id, length(seq) AS n FROM ctg JOIN pas USING (id)",
        "faa_filter": f"""WITH {CTG}, pro AS (SELECT id || '_' || CAST(ord % 7 AS VARCHAR) AS id, 'protein [' || CAST(ord + 1 AS VARCHAR) || ']' AS description FROM ctg)
 SELECT * FROM pro WHERE regexp_replace(id, '_[0-9]+$', '') IN (SELECT id FROM pas) OR regexp_extract(description, '\\[([^\\]]+)\\]', 1) IN (SELECT id FROM pas)""",
        "gff_filter": f"WITH {CTG}, {GFF} SELECT line_no, raw FROM gff WHERE raw LIKE '#%' OR string_split(raw, chr(9))[1] IN (SELECT id FROM pas)",
        "bgc_regions": f"WITH {GFF} SELECT line_no, seqid, s AS start, e AS \"end\", attributes, idx FROM reg",
        "region_extract": f"""WITH {CTG}, {GFF} SELECT idx, 'sample_gecco_bgc_' || idx AS id, 'BGC region ' || idx || ' from gecco | ' || seqid || ':' || (s + 1) || '-' || e AS description, substr(seq, CAST(s + 1 AS BIGINT), greatest(e - s, 0)) AS seq, s AS start, e AS "end", seqid
 FROM (SELECT idx, seqid, greatest(reg.s, 0) AS s, least(reg.e, length(seq)) AS e, seq FROM reg JOIN ctg ON ctg.id = seqid)""",
        "seq_dedup": f"WITH {CTG} SELECT min(ord) AS ord, sha256(seq) AS sha256 FROM ctg GROUP BY 2",
        "token_batches": """WITH RECURSIVE k AS (SELECT source AS file, doc_id AS ord, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents WHERE length(text) BETWEEN 1 AND 10000),
 r AS (SELECT file, ord, p, 0::BIGINT AS batch, CASE WHEN n > 6000 THEN 0 ELSE n END AS used, (n > 6000)::BIGINT AS bump FROM k WHERE p = 1
 UNION ALL SELECT k.file, k.ord, k.p, CASE WHEN used > 0 AND used + n > 6000 THEN batch + bump + 1 ELSE batch + bump END,
 CASE WHEN used = 0 AND n > 6000 THEN 0 WHEN used > 0 AND used + n > 6000 THEN n ELSE used + n END, (used = 0 AND n > 6000)::BIGINT FROM r JOIN k ON k.file = r.file AND k.p = r.p + 1)
 SELECT file, ord, batch FROM r""",
        "seq_validation": """SELECT doc_id AS ord, upper(trim(w)) AS seq, CASE WHEN length(trim(w)) = 0 THEN 'empty' ELSE coalesce(array_to_string(list_sort(list_filter(list_distinct(string_split(upper(trim(w)), '')), lambda c: NOT regexp_full_match(c, '[A-Z]'))), ''), '') END AS bad
 FROM (SELECT doc_id, replace(text, 'ß', 's') AS w FROM documents)""",
        "bgc_pool_mean": f"WITH {PRO} SELECT bgc, count(*) AS n_proteins, k, round(avg(CAST(x AS DECIMAL(28, 14)))::DOUBLE, 6) AS x FROM pro GROUP BY bgc, k",
        "bgc_pool_max": f"WITH {PRO} SELECT bgc, count(*) AS n_proteins, k, round(max(x), 6) AS x FROM pro GROUP BY bgc, k",
        "bgc_pool_pe": f"WITH {PEN} SELECT bgc, n AS n_proteins, k, round(x / m, 6) AS x FROM pol JOIN pon USING (bgc)",
        "layer_extract": "SELECT vec_id AS ord, embedding[1]::DOUBLE AS first, embedding[33]::DOUBLE AS second, embedding[33]::DOUBLE AS last FROM embeddings",
        "strategy_id": "SELECT CAST(label AS VARCHAR) AS bgc, 'layer_final__ppnorm_0__agg_mean__postnorm_1__pebefore_1__scale_0.5000' AS strategy_id FROM embeddings GROUP BY label",
        "run_fingerprint": f"""WITH {SIG} SELECT sha256(concat_ws('|', 'sources=lineitem,orders', 'weights=0.500000,0.500000', 'k=10', 'res={",".join(f"{r:.6f}" for r in RESOLUTIONS)}', 'seed=42',
 'ibgc_etag=' || (SELECT count(*) || ':' || max(o_orderkey) FROM orders), 'domain_etag=' || (SELECT count(*) || ':' || count(DISTINCT f) FROM dom))) AS run_sha""",
    }
    return q
