"""SQL for DuckDB that gives the rows of the registered queries, written apart from the operators."""

from __future__ import annotations

from procsim.functions.metrics import METHODS
from procsim.operators.items import KEYS
from procsim.operators.rollup import CATEGORIES, GROUPS
from procsim.operators.viewer import PAGE, TAIL, VIEWER
from procsim.plans.samples import DOCUMENTS

CASES = """cases AS (SELECT CAST(user_id AS VARCHAR) AS model_id, list(event_type ORDER BY ts, event_id) AS trace FROM events GROUP BY user_id, CAST(ts AS DATE)),
tr AS (SELECT DISTINCT model_id, trace FROM cases),
users AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS model_id FROM events),
pairs AS (SELECT a.model_id AS model_a, b.model_id AS model_b FROM users a JOIN users b ON a.model_id < b.model_id)"""


def grams(n: int, pad: bool = True, of: str = "tr") -> str:
    whole = "['<START>'] || trace || ['<END>']" if pad else "trace"
    return f"SELECT model_id, unnest([list_slice(w, i, i + {n - 1}) FOR i IN range(1, len(w) - {n} + 2)]) AS token FROM (SELECT model_id, {whole} AS w FROM {of})"


def overlap(name: str, tokens: str) -> str:
    return f"""{name}_tok AS (SELECT DISTINCT model_id, token FROM ({tokens})),
{name}_size AS (SELECT model_id, count(*) AS n FROM {name}_tok GROUP BY 1),
{name}_shared AS (SELECT a.model_id AS model_a, b.model_id AS model_b, count(*) AS shared FROM {name}_tok a JOIN {name}_tok b ON a.token = b.token AND a.model_id < b.model_id GROUP BY 1, 2),
{name} AS (SELECT p.model_a, p.model_b, coalesce(x.n, 0) AS n1, coalesce(y.n, 0) AS n2, coalesce(s.shared, 0) AS shared FROM pairs p
LEFT JOIN {name}_size x ON x.model_id = p.model_a LEFT JOIN {name}_size y ON y.model_id = p.model_b LEFT JOIN {name}_shared s ON s.model_a = p.model_a AND s.model_b = p.model_b)"""


def metric(method: str, p: str = "") -> str:
    s, a, b = f"{p}shared", f"{p}n1", f"{p}n2"
    over = {"dice": (f"2.0 * {s}", f"({a} + {b})"), "jaccard": (f"1.0 * {s}", f"({a} + {b} - {s})"), "overlap": (f"1.0 * {s}", f"least({a}, {b})"),
            "precision": (f"1.0 * {s}", b), "recall": (f"1.0 * {s}", a)}[method]
    empty = "0.0" if method in ("precision", "recall") else "1.0"
    return f"CAST(CASE WHEN {a} = 0 AND {b} = 0 THEN {empty} WHEN {over[1]} = 0 THEN 0.0 ELSE CAST({over[0]} AS DOUBLE) / {over[1]} END AS DOUBLE)"


WHOLE = overlap("ov", "SELECT model_id, trace AS token FROM tr")
BIGRAMS = overlap("gr", grams(2))


def null_if_empty(score: str, p: str = "") -> str:
    return f"CASE WHEN {p}n1 > 0 OR {p}n2 > 0 THEN {score} END"


def trace_sim(method: str) -> str:
    return f"WITH {CASES}, {WHOLE} SELECT model_a, model_b, n1, n2, shared, round({null_if_empty(metric(method))}, 6) AS score FROM ov"


def ngram_sim(n: int, method: str, pad: bool = True) -> str:
    return f"WITH {CASES}, {overlap('gr', grams(n, pad))} SELECT model_a, model_b, n1, n2, shared, round({metric(method)}, 6) AS score FROM gr"


def stats(of: str) -> str:
    return f"""SELECT t.model_id, count(*) AS num_variants, CAST(min(len(trace)) AS INTEGER) AS min_length, CAST(max(len(trace)) AS INTEGER) AS max_length,
round(avg(len(trace)), 6) AS avg_length, any_value(u.n) AS unique_activities FROM {of} t
JOIN (SELECT model_id, count(DISTINCT label) AS n FROM (SELECT model_id, unnest(trace) AS label FROM {of}) GROUP BY 1) u ON u.model_id = t.model_id GROUP BY t.model_id"""


STATS = ("num_variants", "min_length", "max_length", "avg_length", "unique_activities")
COMPARE = f"""WITH {CASES}, {WHOLE}, {BIGRAMS}, st AS ({stats('tr')})
SELECT o.model_a, o.model_b, o.shared AS common, o.n1 - o.shared AS unique_1, o.n2 - o.shared AS unique_2,
{", ".join(f"round({null_if_empty(metric(m, 'o.'), 'o.')}, 6) AS trace_{m}" for m in ("jaccard", "dice", "overlap"))},
{", ".join(f"round({metric(m, 'g.')}, 6) AS bigram_{m}" for m in ("jaccard", "dice", "overlap"))},
{", ".join(f"{x}.{c} AS {c}_{x}" for x in "ab" for c in STATS)}
FROM ov o JOIN gr g ON g.model_a = o.model_a AND g.model_b = o.model_b LEFT JOIN st a ON a.model_id = o.model_a LEFT JOIN st b ON b.model_id = o.model_b"""
SHARED_VARIANTS = f"""WITH {CASES},
both_ AS (SELECT p.model_a, p.model_b, a.trace, 'both' AS side FROM pairs p JOIN tr a ON a.model_id = p.model_a JOIN tr b ON b.model_id = p.model_b AND b.trace = a.trace),
one AS (SELECT p.model_a, p.model_b, a.trace, '1' AS side FROM pairs p JOIN tr a ON a.model_id = p.model_a WHERE NOT EXISTS (SELECT 1 FROM tr b WHERE b.model_id = p.model_b AND b.trace = a.trace)),
two AS (SELECT p.model_a, p.model_b, b.trace, '2' AS side FROM pairs p JOIN tr b ON b.model_id = p.model_b WHERE NOT EXISTS (SELECT 1 FROM tr a WHERE a.model_id = p.model_a AND a.trace = b.trace))
SELECT model_a, model_b, side, count(*) AS n, min(array_to_string(trace, '>')) AS first_trace FROM (SELECT * FROM both_ UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1, 2, 3"""

MODELS = """oc AS (SELECT CAST(c_nationkey AS VARCHAR) AS m, o.*, c_mktsegment AS seg, o_orderstatus = 'F' AND o_orderkey % 50 = 0 AS nested FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
ln AS (SELECT m, nested, o_orderkey AS ok, p_brand AS brand, p_type AS type, row_number() OVER w AS rn, lead(p_brand) OVER w AS next_brand, lead(p_type) OVER w AS next_type
  FROM lineitem l JOIN oc ON oc.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey WINDOW w AS (PARTITION BY m, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
sp AS (SELECT m, o_orderkey AS ok, CASE WHEN o_orderkey % 100 = 0 THEN '' ELSE o_orderpriority END AS name FROM oc WHERE nested),
sps AS (SELECT m, ok, name, CASE WHEN name <> '' THEN name ELSE '__sp' || CAST(row_number() OVER (PARTITION BY m, name = '' ORDER BY ok) - 1 AS VARCHAR) END AS scope FROM sp),
sup AS (SELECT CAST(s_nationkey AS VARCHAR) AS m, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'Exclusive' WHEN 1 THEN 'Parallel' ELSE 'Inclusive' END AS type FROM supplier),
msg AS (SELECT m, o_orderpriority AS a, lead(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM oc),
na AS (SELECT CAST(n_nationkey AS VARCHAR) AS m, n_name AS name FROM nation),
it AS (
SELECT m AS model_id, 'activity_names' AS key, brand AS item FROM ln UNION ALL SELECT m, 'activity_types', type FROM ln
UNION ALL SELECT m, 'activity_names', name FROM sp UNION ALL SELECT m, 'activity_types', 'Subprocess' FROM sp
UNION ALL SELECT m, 'event_names', o_orderpriority FROM oc UNION ALL SELECT m, 'event_types', o_orderstatus FROM oc
UNION ALL SELECT m, 'gateway_names', name FROM sup UNION ALL SELECT m, 'gateway_types', type FROM sup
UNION ALL SELECT m, 'seq_flows_str', brand || '|' || next_brand FROM ln WHERE next_brand IS NOT NULL AND NOT nested
UNION ALL SELECT m, 'mes_flows_str', a || '|' || b FROM msg WHERE b IS NOT NULL
UNION ALL SELECT na.m, 'lane_names', na.name || CASE WHEN s.seg IS NULL THEN '' ELSE '|' || s.seg END FROM na LEFT JOIN (SELECT DISTINCT m, seg FROM oc) s ON s.m = na.m
UNION ALL SELECT oc.m, 'lane_with_refs', na.name || '|' || seg || '|' || o_orderpriority FROM oc JOIN na ON na.m = oc.m
UNION ALL SELECT m, 'subprocess_names', name FROM sps WHERE name <> ''
UNION ALL SELECT ln.m, 'subprocess_elemrefs', scope || '|' || brand FROM ln JOIN sps ON sps.m = ln.m AND sps.ok = ln.ok
UNION ALL SELECT ln.m, 'subprocess_flows', scope || '|' || brand || '|' || next_brand FROM ln JOIN sps ON sps.m = ln.m AND sps.ok = ln.ok WHERE next_brand IS NOT NULL),
ct AS (SELECT model_id, key, item, count(*) AS n FROM it GROUP BY 1, 2, 3)"""
FINE = f"""{MODELS}, ks AS (SELECT unnest([{", ".join(f"'{k}'" for k in KEYS)}]) AS key),
np AS (SELECT a.m AS model_a, b.m AS model_b FROM na a JOIN na b ON a.m < b.m),
sz AS (SELECT model_id, key, CAST(sum(n) AS BIGINT) AS n FROM ct GROUP BY 1, 2),
cm AS (SELECT a.model_id AS model_a, b.model_id AS model_b, a.key, CAST(sum(least(a.n, b.n)) AS BIGINT) AS shared FROM ct a JOIN ct b ON a.key = b.key AND a.item = b.item AND a.model_id < b.model_id GROUP BY 1, 2, 3),
fn AS (SELECT np.model_a, np.model_b, ks.key, coalesce(x.n, 0) AS n1, coalesce(y.n, 0) AS n2, coalesce(cm.shared, 0) AS shared FROM np CROSS JOIN ks
LEFT JOIN sz x ON x.model_id = np.model_a AND x.key = ks.key LEFT JOIN sz y ON y.model_id = np.model_b AND y.key = ks.key
LEFT JOIN cm ON cm.model_a = np.model_a AND cm.model_b = np.model_b AND cm.key = ks.key),
fs AS (SELECT *, {metric("dice")} AS score FROM fn)"""


def mean(parts: list[tuple[str, str]]) -> str:
    top = " + ".join(f"coalesce({w} * {s}, 0.0)" for w, s in parts)
    bottom = " + ".join(f"CASE WHEN {s} IS NOT NULL THEN {w} ELSE 0.0 END" for w, s in parts)
    return f"CAST(CASE WHEN ({bottom}) = 0 THEN NULL ELSE CAST({top} AS DOUBLE) / ({bottom}) END AS DOUBLE)"


WIDE = f"""{FINE}, wd AS (SELECT model_a, model_b, {", ".join(f"max(CASE WHEN key = '{k}' AND n1 + n2 > 0 THEN score END) AS s_{k}" for k in KEYS)} FROM fs GROUP BY 1, 2),
gp AS (SELECT *, {", ".join(f"{mean([(str(w), f's_{k}') for k, w in parts.items()])} AS group_{g}" for g, parts in GROUPS.items())}, s_subprocess_elemrefs IS NOT NULL AS has_expanded_subprocess FROM wd),
hi AS (SELECT *, {mean([("1.0", f"group_{g}") for g in ("activities", "events", "gateways")])} AS high_elements, group_flows AS high_flows, group_pools AS high_organizational, group_subprocesses AS high_subprocess,
CAST(0.3 AS DOUBLE) AS weight_elements, CAST(0.5 AS DOUBLE) AS weight_flows, CAST(CASE WHEN has_expanded_subprocess THEN 0.15 ELSE 0.2 END AS DOUBLE) AS weight_organizational,
CAST(CASE WHEN has_expanded_subprocess THEN 0.05 ELSE 0.0 END AS DOUBLE) AS weight_subprocess FROM gp),
al AS (SELECT *, {mean([(f"weight_{c}", f"high_{c}") for c in CATEGORIES])} AS overall FROM hi)"""
CUSTOM = {"elements": 0.4, "flows": 0.3, "organizational": 0.2, "subprocess": 0.1}
USER = mean([(str(w), f"high_{c}") for c, w in CUSTOM.items()])


def hybrid(weight: float) -> str:
    """Pairs of either side: users that are no nation have no structural score."""
    return f"""WITH {CASES}, {BIGRAMS}, {WIDE}, gs AS (SELECT model_a, model_b, {metric("jaccard")} AS behavioral FROM gr), bo AS (SELECT model_a, model_b, al.overall AS s, gs.behavioral AS b FROM al FULL JOIN gs USING (model_a, model_b))
SELECT model_a, model_b, round(s, 6) AS structural, round(b, 6) AS behavioral, round(CAST(CASE WHEN s IS NULL THEN b WHEN b IS NULL THEN s ELSE {weight} * s + {1 - weight} * b END AS DOUBLE), 6) AS hybrid,
CAST(CASE WHEN s IS NULL THEN 0 WHEN b IS NULL THEN 1 ELSE {weight} END AS DOUBLE) AS structural_weight, CAST(CASE WHEN b IS NULL THEN 0 WHEN s IS NULL THEN 1 ELSE {1 - weight} END AS DOUBLE) AS behavioral_weight FROM bo"""


def rescale(pin: str | None) -> str:
    return f"""WITH w AS (SELECT c_mktsegment AS "group", o_orderpriority AS name, count(*) / 10.0 AS weight, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS idx, o_orderpriority NOT LIKE '4%' AS live
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
f AS (SELECT *, live AND name = '{pin or ''}' AS pinned, live AND name <> '{pin or ''}' AS free FROM w),
k AS (SELECT *, coalesce(max(CASE WHEN pinned THEN least(greatest(trunc(weight), 0), 100) END) OVER (PARTITION BY "group"), 0) AS kept, sum(CASE WHEN free THEN weight ELSE 0 END) OVER (PARTITION BY "group") AS total FROM f),
e AS (SELECT *, CASE WHEN free THEN (100 - kept) * weight / total ELSE 0 END AS exact FROM k),
d AS (SELECT *, floor(round(exact, 9)) AS down, 100 - kept - sum(floor(round(exact, 9))) OVER (PARTITION BY "group") AS missing FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY free DESC, round(exact - down, 9) DESC, idx) AS place FROM d)
SELECT "group", idx, name, CAST(CASE WHEN pinned THEN kept WHEN free THEN down + CASE WHEN place <= missing THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS percent FROM r"""


def greedy(candidates: str) -> str:
    return f"""WITH RECURSIVE c AS ({candidates}), k AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, name2 DESC, name1 DESC) AS i FROM c),
st AS (SELECT scope, 0 AS i, CAST([] AS VARCHAR[]) AS u1, CAST([] AS VARCHAR[]) AS u2, CAST(NULL AS VARCHAR) AS name2, CAST(NULL AS VARCHAR) AS name1, CAST(NULL AS DOUBLE) AS score FROM (SELECT DISTINCT scope FROM c)
UNION ALL SELECT k.scope, k.i, CASE WHEN t.ok THEN list_append(st.u1, k.name1) ELSE st.u1 END, CASE WHEN t.ok THEN list_append(st.u2, k.name2) ELSE st.u2 END,
CASE WHEN t.ok THEN k.name2 END, CASE WHEN t.ok THEN k.name1 END, k.score FROM st JOIN k ON k.scope = st.scope AND k.i = st.i + 1, LATERAL (SELECT NOT list_contains(st.u1, k.name1) AND NOT list_contains(st.u2, k.name2) AS ok) t)
SELECT scope, name2, name1, round(score, 6) AS score FROM st WHERE name2 IS NOT NULL"""


def vectors(threshold: float) -> str:
    return greedy(f"""SELECT CAST(a.label // 2 AS VARCHAR) AS scope, 'v' || CAST(b.vec_id AS VARCHAR) AS name2, 'v' || CAST(a.vec_id AS VARCHAR) AS name1,
list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a JOIN embeddings b ON a.label % 2 = 0 AND b.label = a.label + 1
WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {threshold}""")


EDIT = greedy("""SELECT a.scope, b.name AS name2, a.name AS name1, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS score
FROM (SELECT DISTINCT substr(p_type, 1, 1) AS scope, p_brand AS name FROM part WHERE p_size % 2 = 0) a JOIN (SELECT DISTINCT substr(p_type, 1, 1) AS scope, 'x' || lower(p_brand) AS name FROM part WHERE p_size % 2 = 1) b ON a.scope = b.scope
WHERE 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) >= 0.7""")


def rows(columns: str, *values: tuple) -> str:
    """Rows known by hand."""
    show = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    names = [c.split()[0] for c in columns.split(", ")]
    listed = ", ".join("(" + ", ".join(map(show, v)) + ")" for v in values)
    return f"SELECT {', '.join(f'CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}' for c in columns.split(', '))} FROM (VALUES {listed}) t({', '.join(names)})"


#: The plain sample models by hand: kind, id, name and type of their nodes, and their flows in order.
PLAIN = {
    "line.bpmn": ("a Pick Task, b Pack Task, c Ship Task", "s>a a>b b>c c>e"),
    "renamed.bpmn": ("a Gather Task, b Wrap Task, c Send_off Task", "s>a a>b b>c c>e"),
    "empty.bpmn": ("", "s>e"),
    "choice.bpmn": ("g1 - Exclusive, a Pick Task, b Pack Task, g2 - Exclusive", "s>g1 g1>a g1>b a>g2 b>g2 g2>e"),
    "both.bpmn": ("g1 - Parallel, a Pick Task, b Pack Task, g2 - Parallel", "s>g1 g1>a g1>b a>g2 b>g2 g2>e"),
    "nojoin.bpmn": ("g1 - Parallel, a Pick Task, b Pack Task", "s>g1 g1>a g1>b a>e b>e"),
    "loop.bpmn": ("a Pick Task, g1 - Exclusive", "s>a a>g1 g1>a g1>e"),
}
PLAIN_NODES = [
    (m, "event" if k.endswith("Event") else "activity" if k == "Task" else "gateway", i, n.replace("_", " ").strip("-"), k, None, False)
    for m, (inner, _) in PLAIN.items() for i, n, k in (x.split(" ") for x in ("s Begin StartNoneEvent", *inner.split(", "), "e Done EndNoneEvent") if x)
]
PLAIN_FLOWS = [(m, "sequence", f"f{i}", *f.split(">"), None, None) for m, (_, flows) in PLAIN.items() for i, f in enumerate(flows.split(" "))]
RUNS = f"""{CASES}, {WHOLE}, {BIGRAMS}, rt0 AS (SELECT o.model_a || '-' || o.model_b AS pair_id, o.model_a, o.model_b, CAST(o.n1 AS INTEGER) AS size_a, CAST(o.n2 AS INTEGER) AS size_b,
round({metric("jaccard", "o.")}, 9) AS t_semantic, round({metric("dice", "g.")}, 9) AS t_structural, CAST(o.shared * 0.25 + o.n1 * 0.5 AS DOUBLE) AS t_behavioral, o.n1 > 30 AS late_a, o.n2 > 30 AS late_b, o.shared > 0 AS fine
FROM ov o JOIN gr g ON g.model_a = o.model_a AND g.model_b = o.model_b), rt AS (SELECT *, round(t_semantic + t_structural + t_behavioral, 6) AS t_total FROM rt0),
ok AS (SELECT * FROM rt WHERE fine), ms AS (SELECT model, min(size) AS size FROM (SELECT model_a AS model, size_a AS size FROM ok UNION ALL SELECT model_b, size_b FROM ok) GROUP BY 1)"""
SIDES = "SELECT model, min(size) AS size, round(avg(t), 6) AS mean_t, count(*) AS pairs FROM (SELECT model_a AS model, size_a AS size, t_behavioral AS t FROM ok UNION ALL SELECT model_b, size_b, t_behavioral FROM ok) GROUP BY 1"


def stage_stats(source: str, stages: tuple[str, ...]) -> str:
    one = "SELECT '{s}' AS stage, round(quantile_cont({s}, 0.5), 6) AS median_t, round(avg({s}), 6) AS mean_t, round(quantile_cont({s}, 0.95), 6) AS p95_t, round(quantile_cont({s}, 0.99), 6) AS p99_t, round(max({s}), 6) AS max_t, round(sum({s}), 6) AS sum_t FROM {f}"
    return " UNION ALL ".join(one.format(s=s, f=source) for s in stages)


#: By hand from the rules: between an event and a gateway stands nothing, a gateway that splits all ways has a place for each, a choice one for all.
EVENTS = "pin:s e:s, e:s pout:s, pout:s g1, t:g2->e pin:e, pin:e e:e, e:e pout:e"
NET_ARCS = {
    "both.bpmn": f"{EVENTS}, g1 p:g1->a, p:g1->a a, g1 p:g1->b, p:g1->b b, a p:a->g2, p:a->g2 g2, b p:b->g2, p:b->g2 g2, g2 p:g2->e, p:g2->e t:g2->e",
    "gates.bpmn": "_start x1, x2 _end, p2 _end, x1 gout:x1, gout:x1 t:x1->x2, t:x1->x2 gin:x2, gin:x2 x2, gout:x1 t:x1->p1, t:x1->p1 q:x1->p1, q:x1->p1 p1, "
    "p1 p:p1->x2, p:p1->x2 t:p1->x2, t:p1->x2 gin:x2, p1 p:p1->p2, p:p1->p2 t:p1->p2, t:p1->p2 q:p1->p2, q:p1->p2 p2",
    "choice.bpmn": f"{EVENTS}, g1 gout:g1, gout:g1 a, gout:g1 b, a gin:g2, b gin:g2, gin:g2 g2, g2 gout:g2, gout:g2 t:g2->e",
}

VIEWER_HEAD = PAGE.format(viewer=VIEWER, height=500)

ORACLES: dict[str, str] = {
    "trace_variants": f"WITH {CASES} SELECT model_id, array_to_string(trace, '>') AS trace, count(*) AS n FROM cases GROUP BY ALL",
    "trace_stats": f"WITH {CASES} {stats('tr')}",
    "conversation_stats": f"WITH tr AS (SELECT CAST(conv_id AS VARCHAR) AS model_id, list(role ORDER BY turn, role) AS trace FROM conversations GROUP BY conv_id) {stats('tr')}",
    "ngram_counts": f"WITH {CASES} SELECT model_id, array_to_string(token, '>') AS ngram, count(*) AS n FROM ({grams(2, True, 'cases')}) GROUP BY ALL",
    **{f"trace_sim_{m}": trace_sim(m) for m in METHODS},
    **{f"ngram_sim_2_{m}": ngram_sim(2, m) for m in METHODS},
    **{f"ngram_sim_{n}_jaccard": ngram_sim(n, "jaccard") for n in (1, 3)},
    "ngram_unpadded": ngram_sim(2, "jaccard", False), "trace_compare": COMPARE, "shared_variants": SHARED_VARIANTS,
    "set_overlap": f"WITH {CASES}, {WHOLE} SELECT model_a, model_b, n1 - shared AS only_1, shared, n2 - shared AS only_2, n1 + n2 - shared AS either FROM ov",
    "behavioral_active_trace": f"WITH {CASES}, {WHOLE} SELECT model_a, model_b, round({null_if_empty(metric('jaccard'))}, 6) AS score FROM ov",
    **{f"behavioral_active_{n}": f"WITH {CASES}, {overlap('gr', grams(n))} SELECT model_a, model_b, round({metric('jaccard')}, 6) AS score FROM gr" for n in (1, 3, 5)},
    **{f"items_{k}": f"WITH {MODELS} SELECT model_id, item, n FROM ct WHERE key = '{k}'" for k in KEYS},
    "index_list": f"WITH {MODELS} SELECT model_id, key, item || CAST(row_number() OVER (PARTITION BY model_id, key, item) AS VARCHAR) AS indexed FROM it",
    **{f"fine_scores_{m}": f"WITH {FINE} SELECT model_a, model_b, key, n1, n2, shared, round({metric(m)}, 6) AS score FROM fn" for m in METHODS},
    "data_presence": f"WITH {FINE} SELECT model_a, model_b, key, n1 + n2 > 0 AS present FROM fn",
    "pair_weight": f"WITH {FINE} SELECT model_a, model_b, key, round(CAST(CASE WHEN n1 + n2 = 0 THEN 0 ELSE 2.0 * n1 * n2 / (n1 + n2) END AS DOUBLE), 6) AS weight FROM fn",
    "grouped_scores": f"WITH {WIDE} SELECT model_a, model_b, {', '.join(f'round(group_{g}, 6) AS group_{g}' for g in GROUPS)} FROM al",
    "high_level": f"WITH {WIDE} SELECT model_a, model_b, {', '.join(f'round(high_{c}, 6) AS high_{c}' for c in CATEGORIES)} FROM al",
    "overall_default": f"WITH {WIDE} SELECT model_a, model_b, round(overall, 6) AS overall FROM al",
    "overall_custom": f"WITH {WIDE} SELECT model_a, model_b, round({USER}, 6) AS overall FROM al",
    "weights_used": f"WITH {WIDE} SELECT model_a, model_b, has_expanded_subprocess, {', '.join(f'weight_{c}' for c in CATEGORIES)} FROM al",
    **{f"hybrid_{w}": hybrid(w / 100) for w in (0, 25, 50, 100)},
    "hybrid_nulls": rows("model_a VARCHAR, hybrid DOUBLE, structural_weight DOUBLE, behavioral_weight DOUBLE", ("a", 0.6875, 0.25, 0.75), ("b", 0.35, 0.25, 0.75), ("c", 0.15, 0, 1), ("d", 0.95, 1, 0), ("e", None, 0, 0)),
    "weighted_contrib": f"""WITH {WIDE}, lg AS ({" UNION ALL ".join(f"SELECT model_a, model_b, '{c}' AS category, high_{c} AS score, {w} AS w FROM al WHERE high_{c} IS NOT NULL" for c, w in CUSTOM.items())})
SELECT model_a, model_b, category, round(score, 6) AS score, round(score * CAST(w AS DOUBLE) / sum(w) OVER p, 6) AS contribution, round(score / count(*) OVER p, 6) AS equal_contribution FROM lg WINDOW p AS (PARTITION BY model_a, model_b)""",
    "user_overall": f"""WITH {WIDE} SELECT model_a, model_b, round({USER}, 6) AS user_overall, round({mean([("1.0", f"high_{c}") for c in CATEGORIES])}, 6) AS equal_overall,
{", ".join(f"high_{c} IS NOT NULL{' AND has_expanded_subprocess' if c == 'subprocess' else ''} AS live_{c}" for c in CATEGORIES)} FROM al""",
    "breakdown": f"""WITH {FINE} SELECT model_a, model_b, key AS family, CASE WHEN key LIKE '%flows_str' THEN 'flows' WHEN key LIKE 'lane%' THEN 'organizational' WHEN key LIKE 'subprocess%' THEN 'subprocess' ELSE 'elements' END AS category,
round(CASE WHEN n1 + n2 > 0 THEN score ELSE 0 END, 6) AS score, n1 + n2 > 0 AS present FROM fs""",
    "element_counts": f"""WITH {MODELS} SELECT na.m AS model_id, (SELECT count(*) FROM it WHERE model_id = na.m AND key = 'activity_names') AS activity_count, (SELECT count(*) FROM it WHERE model_id = na.m AND key = 'event_names') AS event_count,
(SELECT count(*) FROM it WHERE model_id = na.m AND key = 'gateway_names') AS gateway_count, (SELECT count(*) FROM it WHERE model_id = na.m AND key = 'seq_flows_str') AS sequence_flow_count,
(SELECT count(*) FROM it WHERE model_id = na.m AND key = 'mes_flows_str') AS message_flow_count, CAST(1 AS BIGINT) AS pool_count, (SELECT count(DISTINCT seg) FROM oc WHERE oc.m = na.m) AS lane_count FROM na""",
    "rescale_weights": rescale(None), "rescale_pinned": rescale("2-HIGH"),
    "name_mapping_02": vectors(0.2), "name_mapping_03": vectors(0.3), "name_mapping_edit": EDIT,
    "apply_mapping": rows("model_id VARCHAR, id VARCHAR, name VARCHAR", *[("line.bpmn|renamed.bpmn", *x) for x in (("s", "Begin"), ("a", "Pick"), ("b", "Wrap"), ("c", "Send off"), ("e", "Done"))]),
    "gateway_canon": rows("raw VARCHAR, value VARCHAR", ("XOR", "Exclusive"), (" and ", "Parallel"), ("or", "Inclusive"), ("ParallelGateway", "Parallel"), ("Exclusive_Databased_Gateway", "Exclusive"), ("odd", "odd")),
    "event_type_map": rows("tag VARCHAR, definition VARCHAR, value VARCHAR", ("startEvent", "timer", "StartTimerEvent"), ("startEvent", None, "StartNoneEvent"), ("endEvent", "terminate", "EndNoneEvent"), ("boundaryEvent", "conditional", "IntermediateMessageEventCatching"), ("intermediateThrowEvent", "link", "IntermediateLinkEventThrowing"), ("odd", None, "StartNoneEvent")),
    "stencil_class": rows("raw VARCHAR, value VARCHAR", ("Task", "Activities"), ("VerticalPool", "Pools"), ("ITSystem", "Artifacts"), ("EndTerminateEvent", "Events"), ("MessageFlow", "Message Flows"), ("Hologram", None)),
    "element_type": rows("raw VARCHAR, value VARCHAR", ("StartNoneEvent", "EVENT"), ("Eventbased", "EVENT"), ("EventSubprocess", "EVENT"), ("Exclusive", "GATEWAY"), ("ComplexGateway", "GATEWAY"), ("Task", "TASK"), ("User", "TASK"), ("Pool", "IRRELEVANT"), ("DataStore", "IRRELEVANT"), ("", "IRRELEVANT")),
    "bpmn_nodes": rows("model_id VARCHAR, kind VARCHAR, id VARCHAR, name VARCHAR, type VARCHAR, parent_subprocess VARCHAR, expanded BOOLEAN", *PLAIN_NODES,
        *[("claim.bpmn", *x) for x in (("event", "s", "Claim in", "StartMessageEvent", None, False), ("activity", "a", "Read claim", "User", None, False), ("gateway", "g", "", "Exclusive", None, False), ("event", "us", "", "StartNoneEvent", "u", False), ("activity", "ut", "Assess", "Service", "u", False), ("event", "ue", "", "EndNoneEvent", "u", False), ("activity", "u", "", "Subprocess", None, True), ("event", "e", "Paid", "EndNoneEvent", None, False), ("event", "x", "Refused", "EndNoneEvent", None, False))],
        *[("editor.json", *x) for x in (("event", "s", "Begin", "StartNoneEvent", None, False), ("activity", "a", "Pick", "User", None, False), ("gateway", "g", "", "Exclusive", None, False), ("event", "us", "", "StartNoneEvent", "u", False), ("activity", "ut", "Drive", "Task", "u", False), ("event", "ue", "", "EndNoneEvent", "u", False), ("activity", "u", "Deliver", "Subprocess", None, True), ("event", "e", "Done", "EndNoneEvent", None, False))]),
    "bpmn_flows": rows("model_id VARCHAR, flow_kind VARCHAR, id VARCHAR, source_ref VARCHAR, target_ref VARCHAR, label VARCHAR, owner VARCHAR", *PLAIN_FLOWS,
        *[("claim.bpmn", *x) for x in (("subprocess", "u1", "us", "ut", None, "u"), ("subprocess", "u2", "ut", "ue", None, "u"), ("sequence", "f1", "s", "a", None, None), ("sequence", "f2", "a", "g", None, None), ("sequence", "f3", "g", "u", "covered", None), ("sequence", "f4", "g", "x", "not covered", None), ("sequence", "f5", "u", "e", None, None), ("message", "m1", "P2", "s", "claim", None))],
        *[("editor.json", *x) for x in (("subprocess", "u1", "us", "ut", None, "u"), ("subprocess", "u2", "ut", "ue", None, "u"), ("sequence", "f1", "s", "a", None, None), ("sequence", "f2", "a", "g", None, None), ("sequence", "f3", "g", "u", "far", None), ("sequence", "f4", "g", "e", None, None), ("sequence", "f5", "u", "e", None, None))]),
    "bpmn_lanes": rows("model_id VARCHAR, pool_id VARCHAR, lane_id VARCHAR, ref_id VARCHAR", *[("claim.bpmn", "P1", *x) for x in (("L1", "s"), ("L1", "a"), ("L2", "g"), ("L2", "u"))], *[("editor.json", "P", "L", x) for x in ("s", "a", "g", "us", "ut", "ue", "u", "e")]),
    "sample_similarity": rows("model_a VARCHAR, model_b VARCHAR, high_elements DOUBLE, high_flows DOUBLE, overall DOUBLE", ("line.bpmn", "line.bpmn", 1, 1, 1), ("line.bpmn", "renamed.bpmn", 0.75, 0, 0.28125), ("nojoin.bpmn", "both.bpmn", 0.888889, 0.545455, 0.674242)),
    "net_variants": rows("model_id VARCHAR, trace VARCHAR, kind VARCHAR",
        ("both.bpmn", "Begin>Pack>Pick>Done", "variant"), ("both.bpmn", "Begin>Pick>Pack>Done", "variant"), ("choice.bpmn", "Begin>Pack>Done", "variant"), ("choice.bpmn", "Begin>Pick>Done", "variant"),
        ("claim.bpmn", "Claim in>Read claim>Assess>Paid", "variant"), ("claim.bpmn", "Claim in>Read claim>Refused", "variant"), ("editor.json", "Begin>Pick>Done", "variant"), ("editor.json", "Begin>Pick>Drive>Done", "variant"),
        ("empty.bpmn", "Begin>Done", "variant"), ("line.bpmn", "Begin>Pick>Pack>Ship>Done", "variant"), ("loop.bpmn", "Begin>Pick>Done", "variant"), ("loop.bpmn", "Begin>Pick>Pick>Done", "variant"),
        ("renamed.bpmn", "Begin>Gather>Wrap>Send off>Done", "variant"), ("loop.bpmn", "Begin>Pick>Pick", "partial"), *[("nojoin.bpmn", f"Begin>{t}", "partial") for t in ("Pack>Done>Pick>Done", "Pack>Pick>Done>Done", "Pick>Done>Pack>Done", "Pick>Pack>Done>Done")]),
    "net_status": rows("model_id VARCHAR, variants BIGINT, partials BIGINT, deadlocks BIGINT, status VARCHAR, summary VARCHAR",
        *[(f"{m}", n, 0, 0, "sound", f"sound: {n} variant(s)") for m, n in (("both.bpmn", 2), ("choice.bpmn", 2), ("claim.bpmn", 2), ("editor.json", 2), ("empty.bpmn", 1), ("line.bpmn", 1), ("renamed.bpmn", 1))],
        ("loop.bpmn", 2, 1, 0, "unsound_recovered", "2 sound variant(s), 1 partial trace(s); 1 loop-cap hit(s)"), ("nojoin.bpmn", 0, 4, 1, "unsound_no_variants", "0 sound variant(s), 4 partial trace(s); 1 distinct deadlock marking(s)")),
    # b tasks that never join end b times. Two ends are let through (the loop depth): with b = 2 all ways run dry in one marking, 2 orders times 2 ways; with more,
    # a third end is refused after 3 or 4 tasks and 2 ends, of which there are b! / (b - j)! orders times C(j + 2, 2) - C(j + 2, 1) ways
    "net_corpus": """WITH c AS (SELECT DISTINCT 'c' || CAST(c_custkey AS VARCHAR) AS model_id, c_custkey % 4 AS kind, c_custkey // 16 % 3 + 2 AS b FROM customer)
SELECT model_id, CAST(CASE kind WHEN 0 THEN b WHEN 1 THEN CASE b WHEN 2 THEN 2 WHEN 3 THEN 6 ELSE 24 END WHEN 2 THEN 0 ELSE 2 END AS BIGINT) AS variants,
CAST(CASE kind WHEN 2 THEN CASE b WHEN 2 THEN 4 WHEN 3 THEN 30 ELSE 336 END WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS partials, CAST(CASE WHEN kind = 2 AND b = 2 THEN 1 ELSE 0 END AS BIGINT) AS deadlocks,
CAST(CASE WHEN kind = 3 THEN 1 WHEN kind = 2 AND b = 3 THEN 30 WHEN kind = 2 AND b = 4 THEN 336 ELSE 0 END AS BIGINT) AS loop_hits, CASE kind WHEN 2 THEN 'unsound_no_variants' WHEN 3 THEN 'unsound_recovered' ELSE 'sound' END AS status FROM c""",
    "net_findings": rows("model_id VARCHAR, issue VARCHAR, node_id VARCHAR", ("cut", "isolated_node", "a"), ("cut", "dead_transition_no_preset", "a"), ("cut", "unreachable_from_source", "a"), ("cut", "cannot_reach_sink", "a")),
    "net_arcs": rows("model_id VARCHAR, src VARCHAR, dst VARCHAR, weight INTEGER", *[(m, a, b, 1) for m, text in NET_ARCS.items() for a, b in (x.split(" ") for x in text.split(", "))]),
    "net_states": rows("model_id VARCHAR, variants BIGINT, partials BIGINT, deadlocks BIGINT, loop_hits BIGINT, status VARCHAR", ("fine", 1, 0, 0, 0, "sound"), ("stuck", 0, 1, 1, 0, "unsound_no_variants"),
        ("half", 1, 1, 1, 0, "unsound_recovered"), ("ring", 0, 1, 0, 1, "structurally_broken"), ("long", 0, 0, 0, 0, "exploration_truncated"), ("loose", 1, 3, 0, 3, "unsound_recovered")),
    "net_issues": rows("model_id VARCHAR, issue VARCHAR, node_id VARCHAR", *[("stuck", f"multiple_{k}_places", x) for k, xs in (("source", ("p0", "p2")), ("sink", ("p1", "p2"))) for x in xs], ("stuck", "isolated_node", "p2"),
        ("half", "multiple_sink_places", "p1"), ("half", "multiple_sink_places", "p2"), ("ring", "no_source_place", None), ("ring", "no_sink_place", None),
        *[("loose", f"multiple_{k}_places", x) for k, xs in (("source", ("p0", "p3")), ("sink", ("p1", "p2"))) for x in xs], ("loose", "dead_transition_no_preset", "t2"), ("loose", "dead_transition_no_postset", "t3"),
        *[("loose", "unreachable_from_source", x) for x in ("t2", "p2")], *[("loose", "cannot_reach_sink", x) for x in ("t3", "p3")]),
    "repeated_ids": rows("key VARCHAR, item VARCHAR, n BIGINT", ("activity_names", "First", 1), ("activity_names", "Second", 1), ("activity_types", "Task", 1), ("activity_types", "User", 1), ("event_names", "Over", 1), ("event_types", "EndNoneEvent", 1),
        ("gateway_names", "Which", 1), ("gateway_types", "Exclusive", 1), ("seq_flows_str", "First|Shop", 1), ("seq_flows_str", "Shop|", 1), ("mes_flows_str", "Shop|First", 1), ("lane_names", "Shop|Desk", 1), ("lane_with_refs", "Shop|Desk|First", 1), ("lane_with_refs", "Shop|Desk|Exclusive", 1)),
    "name_mapping_nested": rows("scope VARCHAR, name2 VARCHAR, name1 VARCHAR, score DOUBLE", ("activity", "Load van again", "Load van again", 1), ("activity__subprocess", "Drive homes", "Drive home", 0.909091)),
    "collapsed_types": rows("model_id VARCHAR, item VARCHAR, n BIGINT", ("outer1.json", "Task", 2), ("outer1.json", "Subprocess", 2), ("outer2.json", "Task", 2), ("outer2.json", "Subprocess", 1)),
    "viewer_pages": f"""SELECT 'empty.bpmn' AS model_id, '<iframe src="data:text/html;base64,' || to_base64(encode('{VIEWER_HEAD}' || to_base64(encode('{DOCUMENTS["empty.bpmn"]}')) || '{TAIL}')) || '" width="100%" height="500" style="border:0"></iframe>' AS html""",
    "name_mapping_models": rows("model_a VARCHAR, model_b VARCHAR, scope VARCHAR, name2 VARCHAR, name1 VARCHAR, score DOUBLE",
        *[("line.bpmn", b, k, n, n, 1) for b, k, n in (("choice.bpmn", "activity", "Pick"), ("choice.bpmn", "activity", "Pack"), ("choice.bpmn", "event", "Begin"), ("choice.bpmn", "event", "Done"), ("renamed.bpmn", "event", "Begin"), ("renamed.bpmn", "event", "Done"))]),
    "mapping_summary": rows("model_a VARCHAR, model_b VARCHAR, category VARCHAR, matches BIGINT", ("line.bpmn", "choice.bpmn", "activity", 2), ("line.bpmn", "choice.bpmn", "event", 2), ("line.bpmn", "renamed.bpmn", "event", 2)),
    "model_json": rows("model_id VARCHAR, document VARCHAR", ("empty.bpmn", '{"activities":[],"events":[{"id":"s","name":"Begin","type":"StartNoneEvent"},{"id":"e","name":"Done","type":"EndNoneEvent"}],"gateways":[],"pools":[],"sequenceFlows":[{"id":"f0","sourceRef":"s","targetRef":"e"}],"messageFlows":[]}')),
    "report_health": f"""WITH {RUNS} SELECT count(*) AS total, count(*) FILTER (fine) AS fine, count(*) FILTER (NOT fine) AS failed, count(*) FILTER (fine AND (late_a OR late_b)) AS timed_out,
round(100.0 * count(*) FILTER (NOT fine) / CAST(count(*) AS DOUBLE), 6) AS failed_percent, round(100.0 * count(*) FILTER (fine AND (late_a OR late_b)) / CAST(greatest(1, count(*) FILTER (fine)) AS DOUBLE), 6) AS timed_out_percent FROM rt""",
    "report_sizes": f"WITH {RUNS} SELECT min(size) AS min_size, round(quantile_cont(size, 0.5), 6) AS median_size, round(quantile_cont(size, 0.95), 6) AS p95_size, max(size) AS max_size FROM ms",
    "report_stage_stats": f"WITH {RUNS} {stage_stats('ok', ('t_semantic', 't_structural', 't_behavioral', 't_total'))}",
    "report_stage_share": f"WITH {RUNS} " + " UNION ALL ".join(f"SELECT '{s}' AS stage, round(sum({s}), 6) AS sum_t, round(100.0 * sum({s}) / (sum(t_semantic) + sum(t_structural) + sum(t_behavioral)), 6) AS percent FROM ok" for s in ("t_semantic", "t_structural", "t_behavioral")),
    "report_stage_numbers": stage_stats("lineitem", ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "report_size_buckets": f"""WITH {RUNS}, sm AS (SELECT greatest(size_a, size_b) AS s, t_behavioral AS t, min(greatest(size_a, size_b)) OVER () AS low FROM ok),
bk AS (SELECT CAST(greatest(ceil((s - low) / 4.0), 1) AS BIGINT) AS bucket, low, t FROM sm) SELECT bucket, round(CAST(low + (bucket - 0.5) * 4 AS DOUBLE), 6) AS middle, round(quantile_cont(t, 0.5), 6) AS median_t, round(quantile_cont(t, 0.95), 6) AS p95_t, count(*) AS n FROM bk GROUP BY bucket, low HAVING count(*) >= 30""",
    "report_per_model": f"WITH {RUNS} {SIDES}",
    "report_slowest_model": f"WITH {RUNS} SELECT model, size, mean_t, pairs FROM ({SIDES}) ORDER BY mean_t DESC, model LIMIT 1",
    "report_top_pairs": f"WITH {RUNS} SELECT pair_id, round(t_total, 6) AS t_total FROM ok ORDER BY t_total DESC, pair_id LIMIT 20",
    "report_size_hist": f"""WITH {RUNS}, en AS (SELECT min(size) AS lo, max(size) AS hi FROM ms), b AS (SELECT least(CAST(floor((size - lo) * 30.0 / (hi - lo)) AS INTEGER) + 1, 30) AS bin, count(*) AS models FROM ms, en GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS bin, coalesce(models, 0) AS models FROM range(1, 31) r LEFT JOIN b ON b.bin = r.range""",
    "most_alike_users": f"""WITH {CASES}, {WHOLE}, {BIGRAMS} SELECT o.model_a, o.model_b, round({null_if_empty(metric("jaccard", "o."), "o.")}, 6) AS trace_score, round({metric("jaccard", "g.")}, 6) AS bigram_score
FROM ov o JOIN gr g ON g.model_a = o.model_a AND g.model_b = o.model_b ORDER BY bigram_score DESC, trace_score DESC, model_a, model_b LIMIT 20""",
}
