"""SQL that states the registered queries of ``momentlake.plans.queries``."""

from __future__ import annotations

ITEMS = """
    q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 17
    ), s AS (
        SELECT vec_id AS item_id, label::VARCHAR AS video_id, floor(vec_id / 3) * 0.5 AS t, CASE WHEN vec_id % 3 = 0 THEN 'frame' ELSE 'crop' END AS kind,
            round(list_dot_product(embedding::DOUBLE[], v) / sqrt(list_dot_product(v, v)), 6) AS score
        FROM embeddings, q
    )"""

NAMES = "MAP {0: 'person', 1: 'bicycle', 2: 'car', 3: 'motorcycle', 5: 'bus', 7: 'truck', 24: 'backpack', 25: 'umbrella', 26: 'handbag', 28: 'suitcase'}"


def _best(where: str = "true") -> str:
    return f"best AS (SELECT video_id, t, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY video_id, round(t, 3) ORDER BY score DESC, item_id) AS r FROM s WHERE {where}) WHERE r = 1)"


def _merge(window: float, source: str = "best") -> str:
    return f"""
    ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, item_id) AS rk FROM {source}
    ), walk AS (
        SELECT video_id, rk, [t] AS anchors FROM ranked WHERE rk = 1
        UNION ALL
        SELECT r.video_id, r.rk, CASE WHEN len(list_filter(w.anchors, lambda a: abs(a - r.t) <= {window})) > 0 THEN w.anchors ELSE list_append(w.anchors, r.t) END
        FROM walk w JOIN ranked r ON r.video_id = w.video_id AND r.rk = w.rk + 1
    ), whole AS (SELECT video_id, max_by(anchors, rk) AS anchors FROM walk GROUP BY 1
    ), assigned AS (SELECT r.*, list_filter(f.anchors, lambda a: abs(a - r.t) <= {window})[1] AS hit_t FROM ranked r JOIN whole f ON r.video_id = f.video_id
    ), merged AS (
        SELECT video_id, hit_t AS t, min_by(item_id, rk) AS item_id, max(score) AS score, min(t) AS t_start, max(t) AS t_end, count(*)::INT AS merged FROM assigned GROUP BY video_id, hit_t
    )"""


def _search(where: str) -> str:
    return f"""WITH RECURSIVE {ITEMS}, {_best(where)}, {_merge(3.0)}
        SELECT item_id, video_id, t, score, t_start, t_end, merged, CASE WHEN item_id % 3 = 0 THEN 'frame' ELSE 'crop' END AS kind,
            CASE WHEN item_id % 3 <> 0 THEN coalesce({NAMES}[(item_id % 8)::INT], (item_id % 8)::VARCHAR) END AS label, floor(item_id / 3)::INT AS frame_idx
        FROM merged ORDER BY score DESC, item_id LIMIT 10"""


FINITE = "len(emb) = 512 AND len(list_filter(emb, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
ITEM_CODES = f"""
    u AS (SELECT DISTINCT id, nullif(lower(trim(video_id)), '') AS video_id, round(t, 3) AS t, kind, frame_idx, emb::DOUBLE[] AS e, sqrt(list_dot_product(emb::DOUBLE[], emb::DOUBLE[])) AS n FROM items WHERE id IS NOT NULL AND {FINITE}
    ), asked AS (SELECT id, any_value(e) AS e, any_value(n) AS n FROM u WHERE n > 0 GROUP BY id)"""


def _item_search(n: int) -> str:
    """The first ``n`` items' vectors against all items; the queries' hits are kept apart by a video name that begins with the query."""
    return f"""WITH RECURSIVE {ITEM_CODES}, q AS (SELECT row_number() OVER (ORDER BY id) - 1 AS query, e, n FROM asked ORDER BY id LIMIT {n}
        ), s AS (SELECT query || ':' || u.video_id AS video_id, u.id AS item_id, u.t, CASE WHEN u.n = 0 THEN 0 ELSE round(list_dot_product(u.e, q.e) / (u.n * q.n), 6) END AS score FROM u, q WHERE u.video_id IS NOT NULL AND u.t IS NOT NULL
        ), {_best()}, {_merge(3.0)}, ranked_hits AS (
            SELECT *, split_part(video_id, ':', 1)::INT AS query, substr(video_id, strpos(video_id, ':') + 1) AS video, row_number() OVER (PARTITION BY split_part(video_id, ':', 1) ORDER BY score DESC, item_id)::INT AS rank FROM merged
        ), facts AS (SELECT id, any_value(kind) AS kind, any_value(frame_idx) AS frame_idx FROM u GROUP BY id)"""


def decoded(text: str) -> str:
    """SQL: character references resolved, once."""
    named = "MAP {'&amp;': '&', '&lt;': '<', '&gt;': '>', '&quot;': chr(34), '&apos;': chr(39), '&nbsp;': chr(160), '&shy;': chr(173), '&ndash;': chr(8211), '&mdash;': chr(8212), '&hellip;': chr(8230)}"
    number = "chr(CASE WHEN lower(x[3]) = 'x' THEN try_cast('0x' || x[4:-2] AS INT) ELSE try_cast(x[3:-2] AS INT) END)"
    return f"array_to_string(list_transform(regexp_extract_all({text}, '&#?[0-9A-Za-z]+;|[^&]+|&'), lambda x: CASE WHEN x LIKE '&#%;' THEN coalesce({number}, x) ELSE coalesce(({named})[x], x) END), '')"


EVENTS = "e AS (SELECT event_id, user_id::VARCHAR AS video_id, epoch_us(ts) / 1e6 AS t, event_type, value FROM events)"
TRUTH = EVENTS + """, truth AS (
    SELECT video_id AS query_id, min(t) + (video_id::BIGINT % 25) * 86400 AS lo, min(t) + (video_id::BIGINT % 25) * 86400 + 21600 AS hi FROM e GROUP BY video_id
), hits AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY value DESC, event_id) AS rank FROM e
), firsts AS (
    SELECT query_id, CASE WHEN query_id::BIGINT % 4 = 0 THEN 'scene' ELSE 'event' END AS category,
        (SELECT min(rank) FROM hits h WHERE h.video_id = truth.query_id AND h.t BETWEEN truth.lo - 0.25 AND truth.hi + 0.25)::INT AS first_rank
    FROM truth
)"""
GATE = EVENTS + """, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS k FROM e
), w AS (
    SELECT video_id, k, event_id, t AS last, true AS kept, false AS by_heartbeat FROM n WHERE k = 1
    UNION ALL
    SELECT n.video_id, n.k, n.event_id, CASE WHEN n.value >= 400 OR n.t - w.last >= 86400 THEN n.t ELSE w.last END, n.value >= 400 OR n.t - w.last >= 86400, n.value < 400 AND n.t - w.last >= 86400
    FROM w JOIN n ON n.video_id = w.video_id AND n.k = w.k + 1
)"""
CLEAN = r"lower(trim(regexp_replace({c}, '[\s\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')))"
PIECES = r"$$(?i)<start_of_text>|<end_of_text>|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+$$"


def _boxes(shift: int = 0) -> str:
    return f"""SELECT l_orderkey AS frame, l_linenumber AS pos, (l_partkey % 2)::INT AS cls, round(l_extendedprice / 200000 + 0.001 * l_linenumber, 4) AS conf,
        ((l_partkey * 7 + l_linenumber * 13) % 60 + {shift})::DOUBLE AS x1, ((l_suppkey * 11 + l_linenumber * 5) % 60)::DOUBLE AS y1,
        ((l_partkey * 7 + l_linenumber * 13) % 60 + {shift} + 60 + l_suppkey % 20)::DOUBLE AS x2, ((l_suppkey * 11 + l_linenumber * 5) % 60 + 50 + l_partkey % 30)::DOUBLE AS y2 FROM lineitem"""


def _iou(a: str, b: str) -> str:
    w = f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = lambda r: f"({r}.x2 - {r}.x1) * ({r}.y2 - {r}.y1)"
    return f"({w} * {h} / ({area(a)} + {area(b)} - {w} * {h}))"


VIDEOS = """v AS (SELECT * REPLACE (lower(trim(id)) AS id), row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY indexed_at DESC, removed_at DESC NULLS LAST) AS r FROM videos WHERE trim(id) <> '' AND indexed_at IS NOT NULL
), latest AS (SELECT *, CASE WHEN json_valid(stats_json) THEN stats_json END AS stats FROM v WHERE r = 1)"""


def _code(t: str) -> str:
    return f"printf('%02d:%04.1f', floor({t} / 60)::INT, {t} - 60 * floor({t} / 60))"


SQL = {
    "cosine_topk": f"WITH {ITEMS} SELECT item_id, score FROM s ORDER BY score DESC, item_id LIMIT 10",
    "cosine_true_metric": """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 17)
        SELECT vec_id AS item_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q ORDER BY score DESC, item_id LIMIT 10""",
    "cosine_expression": """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 17)
        SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS cosine FROM embeddings, q""",
    "normalised_vectors": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
        SELECT vec_id, 1.0 AS length, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM e""",
    "multi_query_batch": """WITH q AS (SELECT row_number() OVER (ORDER BY vec_id)::INT - 1 AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (3, 17, 42, 101, 250)
        ), s AS (SELECT e.vec_id, query, round(list_dot_product(e.embedding::DOUBLE[], v) / sqrt(list_dot_product(v, v)), 6) AS score FROM embeddings e, q
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS place FROM s)
        SELECT * FROM r WHERE place <= 10""",
    "multi_query_batch_all": """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0
        ), s AS (SELECT e.vec_id, query, round(list_dot_product(e.embedding::DOUBLE[], v) / sqrt(list_dot_product(v, v)), 6) AS score FROM embeddings e, q
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS place FROM s)
        SELECT * FROM r WHERE place <= 10""",
    "embedding_fidelity": """SELECT a.label, round(avg(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)), 4) AS mean_cosine, count(*) AS n
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY 1""",
    "best_per_timestamp": f"WITH {ITEMS}, {_best()} SELECT * FROM best",
    "merge_hits": f"WITH RECURSIVE {EVENTS}, best AS (SELECT video_id, t, event_id AS item_id, value AS score FROM e), {_merge(43200.0)} SELECT * FROM merged",
    "search_pipeline": _search("true"),
    "frames_only_search": _search("kind = 'frame'"),
    "video_filter_search": _search("video_id IN ('1', '4', '7')"),
    "rerank_blend": f"""WITH RECURSIVE {ITEMS}, {_best()}, {_merge(3.0)}, h AS (
            SELECT *, row_number() OVER (ORDER BY score DESC, item_id)::INT AS rank FROM merged ORDER BY score DESC, item_id LIMIT 50
        ) SELECT item_id, rank, round(0.3 * CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END
            + 0.7 * coalesce(CASE WHEN item_id % 3 <> 0 THEN (item_id % 10) / 10 END, 0.5), 6) AS final_score FROM h""",
    "hits_with_names": """WITH v AS (SELECT lower(trim(id)) AS id, min(name) AS name FROM videos GROUP BY 1
        ), h AS (SELECT DISTINCT hit_id, lower(trim(video_id)) AS id FROM hits WHERE trim(video_id) <> '')
        SELECT coalesce(name, '?') AS video_name, count(*) AS n FROM h LEFT JOIN v USING (id) GROUP BY 1""",
    "enriched_hits": """WITH i AS (SELECT DISTINCT id, label, frame_idx, thumb FROM items), h AS (SELECT DISTINCT hit_id, item_id, score FROM hits)
        SELECT coalesce(label, '-') AS label, count(*) AS n, count(DISTINCT thumb) AS thumbs FROM h JOIN i ON h.item_id = i.id GROUP BY 1""",
    "frame_sampling": """WITH f AS (SELECT l_linenumber AS i, CASE WHEN l_orderkey % 31 > 0 THEN (l_orderkey % 31)::DOUBLE ELSE 25.0 END AS fps FROM lineitem
        ), g AS (SELECT *, greatest(fps / 7.0, 1.0) AS step FROM f)
        SELECT i AS frame_idx, count(*) AS n, round(sum(i / fps), 6) AS t_sum FROM g WHERE i = 0 OR floor((i + 1e-6) / step) > floor((i - 1 + 1e-6) / step) GROUP BY 1""",
    "motion_gate_heartbeat": f"WITH RECURSIVE {GATE} SELECT video_id, event_id AS frame_idx, kept, by_heartbeat FROM w",
    "gate_stats": f"""WITH RECURSIVE {GATE} SELECT video_id, count(*) AS frames_seen, count(*) FILTER (kept) AS frames_kept, count(*) FILTER (NOT kept) AS frames_skipped,
        count(*) FILTER (by_heartbeat) AS kept_by_heartbeat, round(count(*) FILTER (NOT kept) / count(*), 4) AS skip_ratio FROM w GROUP BY 1""",
    "motion_gate_diff": """WITH RECURSIVE n AS (
            SELECT label::VARCHAR AS video_id, vec_id, floor(vec_id / 3) * 0.5 AS t, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY floor(vec_id / 3), vec_id) AS k FROM embeddings
        ), w AS (
            SELECT video_id, k, vec_id, t AS last, x AS ref, 1.0::DOUBLE AS score, true AS kept FROM n WHERE k = 1
            UNION ALL
            SELECT video_id, k, vec_id, CASE WHEN keep THEN t ELSE last END, CASE WHEN keep THEN x ELSE ref END, score, keep FROM (
                SELECT n.*, w.last, w.ref, len(list_filter(list_zip(n.x, w.ref), lambda p: abs(p[1] - p[2]) > 0.15)) / 64 AS score,
                    len(list_filter(list_zip(n.x, w.ref), lambda p: abs(p[1] - p[2]) > 0.15)) / 64 >= 0.5 OR n.t - w.last >= 20 AS keep
                FROM w JOIN n ON n.video_id = w.video_id AND n.k = w.k + 1)
        ) SELECT video_id, vec_id AS frame_idx, round(score, 6) AS score, kept FROM w""",
    "step_sampling": "SELECT event_id, event_type FROM events, (SELECT min(event_id) AS low, count(*) AS n FROM events) WHERE (event_id - low) % greatest(1, n // 100) = 0",
    "first_correct_rank": f"WITH {TRUTH} SELECT query_id, category, first_rank::DOUBLE AS first_rank FROM firsts",
    "recall_mrr_rollup": f"""WITH {TRUTH}, r AS (SELECT *, coalesce(first_rank::DOUBLE, 'inf'::DOUBLE) AS x FROM firsts
        ), g AS (SELECT CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, round(avg((x <= 1)::INT), 4) AS recall_at_1, round(avg((x <= 5)::INT), 4) AS recall_at_5,
            round(avg((x <= 10)::INT), 4) AS recall_at_10, median(x) AS m, round(avg(1 / x), 4) AS mrr, count(*) FILTER (first_rank IS NULL) AS not_found, count(*) AS n FROM r GROUP BY GROUPING SETS ((category), ()))
        SELECT category, recall_at_1, recall_at_5, recall_at_10, CASE WHEN isinf(m) THEN 'inf' ELSE m::VARCHAR END AS median_rank, mrr, not_found, n FROM g""",
    "gt_coverage": f"""WITH {TRUTH}, stamps AS (SELECT DISTINCT video_id, round(t, 3) AS t FROM e
        ), c AS (SELECT query_id, (SELECT count(*) FROM stamps s WHERE s.video_id = truth.query_id AND s.t BETWEEN truth.lo - 0.25 AND truth.hi + 0.25) / (SELECT count(*) FROM stamps) AS coverage FROM truth)
        SELECT round(avg(coverage), 6) AS mean_coverage, round(max(coverage), 6) AS most, count(*) AS n FROM c""",
    "truth_stamps": f"WITH {TRUTH} SELECT event_id FROM e WHERE EXISTS (SELECT 1 FROM truth WHERE truth.query_id = e.video_id AND e.t BETWEEN truth.lo - 0.25 AND truth.hi + 0.25)",
    "distinct_stamps": f"WITH {ITEMS} SELECT DISTINCT video_id, round(t, 3) AS t FROM s",
    "latency_p95": "SELECT event_type, count(value) AS runs, round(avg(value), 2) AS mean_ms, round(quantile_cont(value, 0.95), 2) AS p95_ms FROM events GROUP BY 1",
    "index_cost_rollup": """SELECT event_type, round(sum(value / 10), 2) AS wall_s, sum(event_id % 50)::BIGINT AS seen, sum(event_id % 20)::BIGINT AS kept, sum(event_id % 12)::BIGINT AS crops, round(sum(value), 2) AS duration_s,
        round(sum(event_id % 50) / sum(value / 10), 4) AS frames_per_s, round(sum(value) / sum(value / 10), 4) AS realtime_factor, string_agg(DISTINCT 'v' || (user_id % 7), ', ' ORDER BY 'v' || (user_id % 7)) AS names FROM events GROUP BY 1""",
    "provider_counts": """SELECT CASE WHEN user_id % 4 <> 0 THEN 'P' || (user_id % 4) ELSE 'unknown' END AS provider, count(*) AS n FROM events WHERE event_id % 5 <> 0 AND event_id % 3 <> 0 GROUP BY 1""",
    "config_compare": """WITH h AS (SELECT user_id::VARCHAR AS query_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events
        ), f AS (SELECT query_id, event_type, min(rank) AS r FROM h GROUP BY 1, 2)
        SELECT a.query_id, a.r::DOUBLE AS rank_a, b.r::DOUBLE AS rank_b FROM f a LEFT JOIN f b ON b.query_id = a.query_id AND b.event_type = 'purchase' WHERE a.event_type = 'click'""",
    "truth_remap": """WITH g AS (SELECT id AS query_id, unnest(gt) AS g FROM eval_queries), t AS (SELECT query_id, g.video AS name, g."start" AS s, g."end" AS e FROM g)
        SELECT query_id, CASE WHEN name LIKE '%1.avi' THEN 'long_' || name ELSE name END AS video_name, s + CASE WHEN name LIKE '%1.avi' THEN 10.5 ELSE 0 END AS start, e + CASE WHEN name LIKE '%1.avi' THEN 10.5 ELSE 0 END AS end FROM t""",
    "text_clean": f"SELECT seq, {CLEAN.format(c='query')} AS cleaned FROM (SELECT DISTINCT seq, query FROM audit_log)",
    "pretokenize": f"SELECT query, array_to_string(regexp_extract_all({CLEAN.format(c='query')}, {PIECES}), '|') AS pieces FROM (SELECT DISTINCT query FROM audit_log WHERE query IS NOT NULL)",
    "token_rows": f"""WITH p AS (SELECT regexp_extract_all({CLEAN.format(c='query')}, {PIECES}) AS p FROM (SELECT DISTINCT seq, query FROM audit_log)
        ), r AS (SELECT unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS pos FROM p) SELECT piece, count(*) AS n, max(pos)::INT AS last_pos FROM r GROUP BY 1""",
    "token_pad": f"""WITH p AS (SELECT id, list_transform(regexp_extract_all({CLEAN.format(c='query')}, {PIECES}), lambda x: length(x)::INT) AS p FROM eval_queries
        ) SELECT id, array_to_string(list_slice(list_concat([49406], list_slice(p, 1, 10), [49407], list_transform(range(12), lambda x: 0)), 1, 12), ',') AS tokens FROM p""",
    "token_pad_full": f"""WITH p AS (SELECT id, list_transform(regexp_extract_all({CLEAN.format(c='query')}, {PIECES}), lambda x: length(x)::INT) AS p FROM eval_queries
        ) SELECT id, array_to_string(list_slice(list_concat([49406], list_slice(p, 1, 75), [49407], list_transform(range(77), lambda x: 0)), 1, 77), ',') AS tokens FROM p""",
    "parse_yes_no": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 4 THEN 'yes' END AS answer FROM events",
    "p_yes_logprobs": """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN round(exp(round(-value / 100, 4)) / (exp(round(-value / 100, 4)) + exp(-1.5)), 6) ELSE 1.0 END AS p_yes FROM events""",
    "timecode_format": f"SELECT DISTINCT t, {_code('t')} AS code, greatest(0.0, t - 1) AS start FROM items WHERE t IS NOT NULL",
    "slugs": "SELECT DISTINCT name, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, CASE WHEN contains(name, 'w8a16') THEN 'w8a16' WHEN contains(name, 'w8a8') OR contains(name, 'int8') THEN 'int8' ELSE 'FP32' END AS precision FROM videos",
    "report_numbers": "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '-' WHEN abs(value / 100) >= 1 OR value = 0 THEN printf('%.2f', value / 100) ELSE printf('%.3f', value / 100) END AS shown FROM events",
    "content_ids": "SELECT doc_id, CASE WHEN source IS NOT NULL THEN sha1(source || octet_length(encode(text))::VARCHAR || text)[1:12] END AS video_id FROM documents WHERE text IS NOT NULL",
    "hit_captions": f"""SELECT id, nullif(lower(trim(video_id)), '') || ' @ ' || {_code('greatest(0.0, t)')} || ' · ' || printf('%.3f', conf) || ' · ' || coalesce(label, kind) AS caption
        FROM (SELECT DISTINCT id, video_id, t, kind, label, conf FROM items WHERE t IS NOT NULL AND conf IS NOT NULL)""",
    "hit_captions_all": f"""SELECT id, nullif(lower(trim(video_id)), '') || ' @ ' || {_code('greatest(0.0, t)')} || ' · ' || printf('%.3f', conf) || ' · ' || coalesce(label, kind) AS caption
        FROM (SELECT DISTINCT id, video_id, t, kind, label, coalesce(conf, 1.0::DOUBLE) AS conf FROM items WHERE t IS NOT NULL)""",
    "class_nms": f"""WITH RECURSIVE b AS ({_boxes()}), r AS (SELECT *, row_number() OVER (PARTITION BY frame, cls ORDER BY conf DESC, pos) AS k, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS box FROM b
        ), w AS (
            SELECT frame, cls, k, pos, true AS stays, [box] AS held FROM r WHERE k = 1
            UNION ALL
            SELECT frame, cls, k, pos, free, CASE WHEN free THEN list_append(held, box) ELSE held END FROM (
                SELECT r.*, w.held, len(list_filter(w.held, lambda y: {_iou('y', 'r.box')} > 0.5)) = 0 AS free FROM w JOIN r ON r.frame = w.frame AND r.cls = w.cls AND r.k = w.k + 1)
        ) SELECT frame, cls, pos FROM w WHERE stays""",
    "clipped_boxes": f"""WITH c AS (SELECT frame, pos, trunc(greatest(0, x1))::INT AS x1, trunc(greatest(0, y1))::INT AS y1, trunc(least(100, x2))::INT AS x2, trunc(least(90, y2))::INT AS y2 FROM ({_boxes()}))
        SELECT * FROM c WHERE least(x2 - x1, y2 - y1) >= 20""",
    "box_iou": f"WITH a AS ({_boxes()}), b AS ({_boxes(9)}) SELECT a.frame, a.pos, round({_iou('a', 'b')}, 6) AS iou FROM a JOIN b ON a.frame = b.frame AND b.pos = a.pos + 1",
    "detection_agreement": f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, pos) AS k FROM ({_boxes()})
        ), b AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, pos) AS j FROM ({_boxes(9)}) WHERE pos % 4 <> 0
        ), o AS (SELECT a.frame, a.k, b.j, {_iou('a', 'b')} AS o FROM a JOIN b ON a.frame = b.frame AND a.cls = b.cls
        ), c AS (SELECT a.frame, a.k, coalesce(list({{'o': o.o, 'j': o.j}} ORDER BY o.o DESC, o.j) FILTER (o.j IS NOT NULL), []) AS c FROM a LEFT JOIN o ON o.frame = a.frame AND o.k = a.k GROUP BY 1, 2
        ), w AS (
            SELECT frame, 0::BIGINT AS k, []::BIGINT[] AS used FROM a WHERE k = 1
            UNION ALL
            SELECT frame, k, CASE WHEN best.o >= 0.5 THEN list_append(used, best.j) ELSE used END FROM (
                SELECT c.frame, c.k, w.used, list_filter(c.c, lambda x: NOT list_contains(w.used, x.j))[1] AS best FROM w JOIN c ON c.frame = w.frame AND c.k = w.k + 1)
        ), t AS (SELECT frame, max(len(used)) AS tp FROM w GROUP BY 1), n AS (SELECT (SELECT sum(tp) FROM t)::BIGINT AS tp, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb)
        SELECT tp, na, nb, round(tp / na, 4) AS recall, round(tp / nb, 4) AS precision FROM n""",
    "detection_agreement_whole": f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, pos) AS k FROM ({_boxes()})
        ), b AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, pos) AS j FROM ({_boxes(9)})
        ), o AS (SELECT a.frame, a.k, b.j, {_iou('a', 'b')} AS o FROM a JOIN b ON a.frame = b.frame AND a.cls = b.cls
        ), c AS (SELECT a.frame, a.k, coalesce(list({{'o': o.o, 'j': o.j}} ORDER BY o.o DESC, o.j) FILTER (o.j IS NOT NULL), []) AS c FROM a LEFT JOIN o ON o.frame = a.frame AND o.k = a.k GROUP BY 1, 2
        ), w AS (
            SELECT frame, 0::BIGINT AS k, []::BIGINT[] AS used FROM a WHERE k = 1
            UNION ALL
            SELECT frame, k, CASE WHEN best.o >= 0.5 THEN list_append(used, best.j) ELSE used END FROM (
                SELECT c.frame, c.k, w.used, list_filter(c.c, lambda x: NOT list_contains(w.used, x.j))[1] AS best FROM w JOIN c ON c.frame = w.frame AND c.k = w.k + 1)
        ), t AS (SELECT frame, max(len(used)) AS tp FROM w GROUP BY 1), n AS (SELECT (SELECT sum(tp) FROM t)::BIGINT AS tp, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb)
        SELECT tp, na, nb, round(tp / na, 4) AS recall, round(tp / nb, 4) AS precision FROM n""",
    "top_n_per_frame": f"SELECT frame, pos, place FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, pos)::INT AS place FROM ({_boxes()})) WHERE place <= 3",
    "decoded_boxes": """WITH r AS (SELECT l_orderkey AS frame, l_linenumber AS pos, (l_partkey % 600)::DOUBLE AS cx, (l_suppkey % 400 + 120)::DOUBLE AS cy,
            [round(l_discount * 5, 4), round(l_tax * 5, 4), round(l_discount * 5, 4), round(l_quantity * 0.01, 4)] AS s FROM lineitem
        ), m AS (SELECT *, list_max(s) AS conf, list_position(s, list_max(s))::INT - 1 AS cls FROM r)
        SELECT frame, pos, cls, conf, (cx - 20) / 0.5 AS x1, (cy - 30 - 140) / 0.5 AS y1, (cx - 20) / 0.5 + 80 AS x2, (cy - 30 - 140) / 0.5 + 120 AS y2 FROM m WHERE conf >= 0.3 AND cls IN (0, 1, 2)""",
    "square_crop_geometry": """WITH i AS (SELECT DISTINCT id, x1, y1, x2, y2 FROM items WHERE x1 IS NOT NULL
        ), s AS (SELECT *, greatest(1, round_even(greatest(x2 - x1, y2 - y1) * 1.3::DOUBLE, 0)::INT) AS side FROM i
        ), p AS (SELECT *, round_even((x1 + x2) / 2 - side / 2, 0)::INT AS a, round_even((y1 + y2) / 2 - side / 2, 0)::INT AS b FROM s)
        SELECT id, side, a, b, a + side AS c, b + side AS d, greatest(0, -a) AS "left", greatest(0, -b) AS top, greatest(0, a + side - 1280) AS "right", greatest(0, b + side - 720) AS bottom FROM p""",
    "frame_geometry": """WITH v AS (SELECT DISTINCT width, height, least(640.0::DOUBLE / height, 640.0::DOUBLE / width) AS r, least(1.0::DOUBLE, 960.0::DOUBLE / width) AS s FROM videos WHERE width > 0 AND height > 0
        ), n AS (SELECT *, round_even(width * r, 0)::INT AS nw, round_even(height * r, 0)::INT AS nh FROM v)
        SELECT width, height, round(r, 6) AS ratio, nw, nh, ((640 - nw) // 2)::INT AS "left", ((640 - nh) // 2)::INT AS top, floor(height * 320 / width)::INT AS thumb_h,
            (floor(floor(width * s) / 2) * 2)::INT AS proxy_w, (floor(floor(height * s) / 2) * 2)::INT AS proxy_h, round_even(333 * 320 / width, 0)::INT AS drawn FROM n""",
    "class_labels": f"SELECT DISTINCT l_partkey % 30 AS cls, coalesce({NAMES}[(l_partkey % 30)::INT], (l_partkey % 30)::VARCHAR) AS label FROM lineitem",
    "video_listing": f"""WITH {VIDEOS} SELECT id, name, round((stats->>'$.duration_s')::DOUBLE, 2) AS duration_s, (stats->>'$.motion.frames_seen')::DOUBLE AS frames_seen FROM latest""",
    "video_choices": f"WITH {VIDEOS} SELECT name || ' (' || {_code('coalesce(duration, 0.0)')} || ')' AS choice, id FROM latest",
    "library_summary": f"""WITH {VIDEOS} SELECT name, id, {_code('coalesce(duration, 0.0)')} AS duration, coalesce(stats->>'$.motion.frames_seen', '?') AS frames_seen, coalesce(stats->>'$.items', '?') AS items FROM latest""",
    "probed_videos": f"""WITH {VIDEOS}, f AS (SELECT id, floor(duration * fps) AS n, CASE WHEN width <> 640 AND fps > 0 THEN fps ELSE 25.0 END AS fps FROM latest)
        SELECT id, fps::DOUBLE AS fps, round(coalesce(n / fps, 0.0), 4) AS duration FROM f""",
    "item_counts": "SELECT video_id, count(*) AS n FROM (SELECT DISTINCT id, nullif(lower(trim(video_id)), '') AS video_id FROM items) GROUP BY 1",
    "metadata_scan": "SELECT DISTINCT id, video_id, t, kind FROM items",
    "embedding_export": "SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings WHERE label = 3 AND vec_id % 3 <> 0",
    "embedding_export_all": "SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
    "frame_lookup": """SELECT DISTINCT nullif(lower(trim(i.video_id)), '') AS video_id, i.frame_idx, i.thumb FROM items i JOIN hits h
        ON lower(trim(i.video_id)) = lower(trim(h.video_id)) AND i.frame_idx = round_even(h.t * 25, 0)::INT WHERE i.kind = 'frame' AND trim(i.video_id) <> ''""",
    "upsert_videos": """WITH o AS (SELECT c_custkey::VARCHAR AS id, '/v/' || c_name AS path, c_name AS name, 25.0::DOUBLE AS fps, c_acctbal AS duration, c_nationkey AS width, 720 AS height, CASE WHEN c_custkey % 2 = 0 THEN 'old.mp4' END AS proxy_path, 1.0::DOUBLE AS indexed_at, '{}' AS stats_json FROM customer
        ), n AS (SELECT (s_suppkey * 3)::VARCHAR AS id, '/w/' || s_name AS path, s_name AS name, 30.0::DOUBLE AS fps, s_acctbal AS duration, s_nationkey AS width, 1080 AS height, CASE WHEN s_suppkey % 2 = 0 THEN 'new.mp4' END AS proxy_path, 2.0::DOUBLE AS indexed_at, NULL::VARCHAR AS stats_json FROM supplier)
        SELECT id, coalesce(n.path, o.path) AS path, coalesce(n.name, o.name) AS name, coalesce(n.fps, o.fps) AS fps, coalesce(n.duration, o.duration) AS duration, coalesce(n.width, o.width) AS width, coalesce(n.height, o.height) AS height,
            coalesce(n.proxy_path, o.proxy_path) AS proxy_path, coalesce(n.indexed_at, o.indexed_at) AS indexed_at, coalesce(n.stats_json, o.stats_json) AS stats_json FROM o FULL JOIN n USING (id)""",
    "set_proxy": "SELECT s_suppkey::VARCHAR AS id, s_name, CASE WHEN n_name IS NOT NULL THEN '/proxy/' || n_name END AS proxy_path FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey",
    "clear_and_append": """WITH n AS (SELECT 'new' AS video_id, floor(s_suppkey / 4) * 0.5 AS t, CASE WHEN s_suppkey % 4 = 0 THEN 'frame' ELSE 'crop' END AS kind, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey / 10000 END AS conf, floor(s_suppkey / 4)::INT AS frame_idx FROM supplier)
        SELECT vec_id AS id, label::VARCHAR AS video_id, floor(vec_id / 3) * 0.5 AS t, CASE WHEN vec_id % 3 = 0 THEN 'frame' ELSE 'crop' END AS kind, NULL::DOUBLE AS conf, floor(vec_id / 3)::INT AS frame_idx FROM embeddings WHERE label NOT IN (2, 5)
        UNION ALL SELECT 1000000 + row_number() OVER (ORDER BY video_id, frame_idx, kind <> 'frame', conf DESC), video_id, t, kind, conf, frame_idx FROM n""",
    "audit_tail": """SELECT seq, time, os_user, query, coalesce(array_to_string(videos, ', '), '') AS videos, n_results::DOUBLE AS n_results, CASE WHEN verify THEN 'yes' ELSE 'no' END AS verify
        FROM (SELECT DISTINCT seq, time, os_user, query, videos, n_results, verify FROM audit_log) ORDER BY seq DESC LIMIT 100""",
    "text_clean_entities": f"SELECT doc_id, {CLEAN.format(c=decoded(decoded('text')))} AS cleaned FROM documents",
    "seeded_sampling": "SELECT event_id, event_type FROM (SELECT event_id, event_type FROM events ORDER BY md5('7:' || event_id), event_id LIMIT 50)",
    "item_search": _item_search(1) + """ SELECT item_id, video AS video_id, t, score, t_start, t_end, merged, kind, frame_idx FROM ranked_hits JOIN facts ON facts.id = item_id WHERE rank <= 10""",
    "item_search_batch": _item_search(16) + """ SELECT query, rank, item_id, video AS video_id, t, score, t_start, t_end, merged FROM ranked_hits WHERE rank <= 10""",
    "audit_appends": """SELECT time, os_user, query, array_to_string(videos, ',') AS videos, n_results::DOUBLE AS n_results, verify
        FROM (SELECT DISTINCT seq, time, os_user, query, videos, n_results, verify FROM audit_log WHERE seq IS NOT NULL) ORDER BY seq DESC LIMIT 500""",
    "video_by_id": f"""WITH {VIDEOS} SELECT id, name, round(duration, 3) AS duration FROM latest WHERE id IN (SELECT lower(trim(video_id)) FROM hits)""",
    "answer_fallback": "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN round(value / 1000, 6) END, CASE WHEN event_id % 4 = 0 THEN 1.0 WHEN event_id % 4 = 1 THEN 0.0 END)::DOUBLE AS p_yes FROM events",
    "compute_units": """SELECT CASE WHEN event_id % 5 <> 0 THEN event_type ELSE '?' END AS compute_unit, count(*) AS layers, round(sum(trunc(value * 1000)::BIGINT)::DOUBLE / 1000, 3) AS ms, round(sum(user_id * 4096)::DOUBLE / 1048576, 3) AS mib FROM events GROUP BY 1""",
    "audit_video_names": """SELECT lower(trim(id)) AS video_id, min(name) AS name FROM videos
        WHERE lower(trim(id)) IN (SELECT lower(trim(v)) FROM (SELECT unnest(videos) AS v FROM audit_log) WHERE trim(v) <> '') GROUP BY 1""",
}
