"""Oracle SQL (DuckDB) for every registered key.

The stand-in views of ``sources.standins`` are rebuilt here as CTEs over the
pre-registered tables; each key's SQL names the CTEs it needs and
``build_sql`` prepends them (with their dependencies) in order.
"""

from __future__ import annotations

from pricelens.plans import sqlx as X
from pricelens.plans import keyparams as KP
from pricelens.plans import splices as SP
from pricelens.params import BLACKLIST_TERMS

# name -> (dependencies, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, deps: tuple[str, ...] = ()) -> None:
    CTES[name] = (deps, body)


def build_sql(select: str, *uses: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][0]:
            visit(dep)
        order.append(n)

    for u in uses:
        visit(u)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + select


# --- stand-in views --------------------------------------------------------

cte("obs", """
SELECT CAST(user_id AS VARCHAR) AS id, event_type AS query,
       CAST(floor(value) AS BIGINT) AS price_nok, ts AS scraped_at,
       event_id AS seq, CAST(ts AS DATE) AS scan_day
FROM events""")

cte("hist", """
SELECT listing_id, query, price, seen_at, seq FROM (
  SELECT id AS listing_id, query, price_nok AS price, scraped_at AS seen_at, seq,
         lag(price_nok) OVER (PARTITION BY id, query ORDER BY scraped_at, seq) AS prev
  FROM obs WHERE price_nok <> 0) t
WHERE prev IS NULL OR prev <> price""", ("obs",))

cte("lv_last", """
SELECT * FROM (
  SELECT o.*, row_number() OVER (PARTITION BY id, query ORDER BY scraped_at DESC, seq DESC) AS rn
  FROM obs o) t WHERE rn = 1""", ("obs",))

cte("lv_base", f"""
SELECT l.id, l.query, l.price_nok, l.scraped_at, l.seq,
       l.scan_day = m.last_day AS is_active,
       'listing ' || l.id AS title, {X.q('https://www.finn.no/item/')} || l.id AS url,
       {SP.LISTING_TEXT} AS description
FROM lv_last l JOIN (SELECT query, max(scan_day) AS last_day FROM obs GROUP BY query) m
  USING (query)""", ("lv_last",))

cte("lv_med", """
SELECT query, quantile_cont(price_nok, 0.5) FILTER (WHERE price_nok > 0) AS median
FROM lv_base GROUP BY query""", ("lv_base",))

cte("listings_v_ps", f"""
SELECT b.*, {X.price_score('b.price_nok', 'm.median')} AS price_score
FROM lv_base b LEFT JOIN lv_med m USING (query)""", ("lv_base", "lv_med"))

cte("listings_v", f"""
SELECT *, {X.composite_score('title', 'description', 'price_score')} AS composite_score
FROM listings_v_ps""", ("listings_v_ps",))

cte("catalog", """
SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS query, p_name AS title,
       CAST(floor(p_retailprice) AS BIGINT) AS price_nok
FROM part""")

cte("market_big", """
SELECT p_brand AS query,
       CAST(CASE WHEN l_quantity > 0 THEN floor(l_extendedprice / l_quantity) END AS BIGINT)
         AS price_nok
FROM lineitem JOIN part ON l_partkey = p_partkey""")

cte("posts", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, lang AS query,
       {SP.POST_TITLE.format(title=X.py_strip('split_part(text, chr(10), 1)'))} AS title,
       {SP.POST_TEXT} AS description, n_chars AS price_nok, source, doc_id
FROM documents""")

cte("reviews", f"""
SELECT CAST(l.doc_id AS VARCHAR) AS id, d.lang AS query,
       {SP.CONDITION.replace('doc_id', 'l.doc_id')} AS condition_score,
       CAST(l.doc_id % 130 AS VARCHAR) AS battery_pct,
       CASE WHEN l.toxic = 1 THEN ['toxic language', 'check seller']
            ELSE CAST([] AS VARCHAR[]) END AS red_flags,
       'quality ' || CAST(l.quality AS VARCHAR) AS summary
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")

cte("captured", f"""
SELECT page_id,
       regexp_extract(url, '^[a-z]+://[^/]*/([a-z]{{2}})/', 1) AS query,
       CASE WHEN regexp_extract(url, '[?&]page=([0-9]+)', 1) <> ''
            THEN TRY_CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS BIGINT)
            ELSE 1 END AS page_num,
       url, {SP.HTML} AS html
FROM pages""")


def _market_report_sql(src: str) -> str:
    """Market report over a view with (query, price_nok)."""
    p = "CASE WHEN price_nok > 0 THEN price_nok END"
    return f"""
SELECT query,
       CAST(count({p}) AS BIGINT) AS count,
       CASE WHEN count({p}) > 0 THEN CAST(sum({p}) AS DOUBLE) / count({p}) ELSE {X.d(0.0)} END AS mean,
       coalesce(quantile_cont({p}, 0.5), {X.d(0.0)}) AS median,
       CASE WHEN count({p}) > 1 THEN {X.py_round(f'stddev_pop({p})', 6)} ELSE {X.d(0.0)} END AS std,
       CAST(coalesce(min({p}), 0) AS BIGINT) AS min_price,
       CAST(coalesce(max({p}), 0) AS BIGINT) AS max_price,
       coalesce(quantile_cont({p}, 0.25), {X.d(0.0)}) AS p25,
       coalesce(quantile_cont({p}, 0.75), {X.d(0.0)}) AS p75
FROM {src} GROUP BY query"""


ORACLE: dict[str, str] = {}

# --- history ---------------------------------------------------------------

ORACLE["price_changes"] = build_sql(
    "SELECT listing_id, query, price, seen_at, seq FROM hist", "hist")

ORACLE["latest_price"] = build_sql("""
SELECT listing_id, query, price, seen_at FROM (
  SELECT *, row_number() OVER (PARTITION BY listing_id, query ORDER BY seen_at DESC, seq DESC) rn
  FROM hist) t WHERE rn = 1""", "hist")

cte("drops", """
SELECT listing_id, query, p[1] AS current_price, latest AS current_seen_at, p[2] AS previous_price
FROM (SELECT listing_id, query, max(seen_at) AS latest, arg_max(price, (seen_at, seq), 2) AS p FROM hist GROUP BY ALL) t
WHERE len(p) = 2 AND p[1] < p[2]""", ("hist",))

_DROPS = """
SELECT d.*, l.title, l.url, l.price_nok AS listing_price,
       CAST(previous_price - current_price AS DOUBLE) / CAST(previous_price AS DOUBLE) * CAST(100.0 AS DOUBLE) AS drop_pct
FROM drops d JOIN listings_v l ON l.id = d.listing_id AND l.query = d.query AND l.is_active
ORDER BY drop_pct DESC, d.query, d.listing_id"""

ORACLE["price_drops"] = build_sql(_DROPS, "drops", "listings_v")
ORACLE["top_price_drops"] = build_sql(_DROPS + "\nLIMIT 10", "drops", "listings_v")

ORACLE["price_history_changes"] = build_sql("""
SELECT listing_id, query, price, seen_at, seq,
       CAST(price - lag(price) OVER w AS DOUBLE) / CAST(lag(price) OVER w AS DOUBLE)
         * CAST(100.0 AS DOUBLE) AS change_pct
FROM hist WINDOW w AS (PARTITION BY listing_id, query ORDER BY seen_at, seq)""", "hist")

ORACLE["listing_histories"] = build_sql("""
SELECT h.listing_id, h.query, l.title, l.url, h.seen_at, h.seq, h.price
FROM hist h JOIN listings_v l ON l.id = h.listing_id AND l.query = h.query""",
    "hist", "listings_v")

# --- market ----------------------------------------------------------------

ORACLE["market_report"] = build_sql(_market_report_sql("market_big"), "market_big")
ORACLE["catalog_report"] = build_sql(_market_report_sql("catalog"), "catalog")

# --- scoring / text --------------------------------------------------------

cte("catalog_scored", f"""
SELECT c.*, {X.price_score('c.price_nok', 'm.median')} AS price_score
FROM catalog c LEFT JOIN (
  SELECT query, quantile_cont(price_nok, 0.5) FILTER (WHERE price_nok > 0) AS median
  FROM catalog GROUP BY query) m USING (query)""", ("catalog",))

cte("posts_scored", f"""
SELECT p.*, {X.price_score('p.price_nok', 'm.median')} AS price_score
FROM posts p LEFT JOIN (
  SELECT query, quantile_cont(price_nok, 0.5) FILTER (WHERE price_nok > 0) AS median
  FROM posts GROUP BY query) m USING (query)""", ("posts",))

ORACLE["price_scores"] = build_sql(
    "SELECT query, id, price_nok, price_score FROM catalog_scored "
    "ORDER BY price_score ASC NULLS LAST, query, id", "catalog_scored")

ORACLE["composite_scores"] = build_sql(
    f"SELECT id, query, price_score, "
    f"{X.composite_score('title', 'description', 'price_score')} AS composite_score "
    f"FROM posts_scored", "posts_scored")

_TEXT = X.score_text("title", "description")
ORACLE["keyword_hits"] = build_sql(
    f"SELECT id, query, {X.keyword_hits(_TEXT, X.POSITIVE_KEYWORDS)} AS positive_hits, "
    f"{X.keyword_hits(_TEXT, X.NEGATIVE_KEYWORDS)} AS negative_hits FROM posts", "posts")

ORACLE["battery_pct"] = build_sql(
    f"SELECT id, query, {X.battery_match(_TEXT)} AS battery_match, "
    f"{X.battery_from_text(_TEXT)} AS battery_pct FROM posts", "posts")

def _percentiles_sql(src: str, ps) -> str:
    """The interpolation rule of ``operators.market.percentiles`` over CTE ``src``."""
    cols = []
    for p in ps:
        k = f"(CAST(n - 1 AS DOUBLE) * {X.d(p / 100.0)})"
        f = f"CAST(floor({k}) AS BIGINT)"
        c = f"least({f} + 1, n - 1)"
        vf = f"CAST(list_sort(v)[{f} + 1] AS DOUBLE)"
        vc = f"CAST(list_sort(v)[{c} + 1] AS DOUBLE)"
        cols.append(f"coalesce(CASE WHEN {f} = {c} THEN {vf} ELSE {vf} * (CAST({c} AS DOUBLE) - {k}) "
                    f"+ {vc} * ({k} - CAST({f} AS DOUBLE)) END, {X.d(0.0)}) AS p{p:g}")
    return (f"SELECT query, {', '.join(cols)} FROM (SELECT query, "
            f"list(price_nok) FILTER (WHERE price_nok > 0) AS v, "
            f"count(*) FILTER (WHERE price_nok > 0) AS n FROM {src} GROUP BY query) t")


ORACLE["market_percentiles"] = build_sql(_percentiles_sql("posts", (0, 10, 25, 50, 75, 90, 100)), "posts")

cte("sc", "SELECT * FROM listings_v WHERE price_score IS NOT NULL", ("listings_v",))
cte("safe", "SELECT query, bool_or(price_score > CAST(-60.0 AS DOUBLE)) AS has_safe "
            "FROM sc GROUP BY query", ("sc",))
ORACLE["select_candidates"] = build_sql("""
SELECT query, id, rank, price_nok, price_score, composite_score FROM (
  SELECT c.*, row_number() OVER (
           PARTITION BY query
           ORDER BY CASE WHEN f.use_cs THEN -coalesce(composite_score, CAST(0 AS DOUBLE))
                         ELSE price_score END, price_score, id) AS rank
  FROM (SELECT s.* FROM sc s JOIN safe USING (query)
        WHERE s.price_score > CAST(-60.0 AS DOUBLE) OR NOT safe.has_safe) c
  JOIN (SELECT s.query, bool_or(s.composite_score IS NOT NULL) AS use_cs
        FROM sc s JOIN safe USING (query)
        WHERE s.price_score > CAST(-60.0 AS DOUBLE) OR NOT safe.has_safe
        GROUP BY s.query) f USING (query)) t
WHERE rank <= 5""", "sc", "safe")


def _blacklisted(title: str, terms) -> str:
    pat = f"(?i)(?:^|{X.NOT_WORD})(?:{'|'.join(terms)})(?:$|{X.NOT_WORD})"
    return f"coalesce(regexp_matches({title}, {X.q(pat)}), false)"


ORACLE["relevant_listings"] = build_sql(
    f"SELECT query, id, title, price_nok FROM catalog WHERE NOT {_blacklisted('title', KP.CATALOG_TERMS)} "
    f"AND NOT coalesce(price_nok < {KP.CATALOG_MIN_PRICE}, false)", "catalog")

_BL = _blacklisted("title", KP.CATALOG_TERMS)
_CHEAP = f"(NOT {_BL} AND coalesce(price_nok < {KP.CATALOG_MIN_PRICE}, false))"
ORACLE["filter_stats"] = build_sql(
    f"SELECT query, count(*) AS n_in, count_if({_BL}) AS dropped_blacklist, "
    f"count_if({_CHEAP}) AS dropped_price, count_if(NOT {_BL} AND NOT {_CHEAP}) AS n_kept "
    f"FROM catalog GROUP BY query", "catalog")

ORACLE["relevant_posts"] = build_sql(
    f"SELECT query, id, price_nok FROM posts WHERE NOT {_blacklisted('title', BLACKLIST_TERMS)} "
    f"AND NOT coalesce(price_nok < {KP.POSTS_MIN_PRICE}, false)", "posts")

ORACLE["deal_bands"] = build_sql(
    f"SELECT id, query, price_score, {X.price_band('price_score')} AS price_band FROM listings_v",
    "listings_v")

ORACLE["listing_display"] = build_sql(
    f"SELECT id, query, "
    f"{X.battery_match(chr(32).join(['concat_ws(', X.q(' '), ', coalesce(title, ', X.q(''), '), coalesce(description, ', X.q(''), '))']))} AS battery_display, "
    f"coalesce({X.storage_of('title')}, '—') AS storage, {X.city_of('location')} AS city, "
    f"{X.format_price('price_nok')} AS price_text "
    f"FROM (SELECT *, source AS location FROM posts) t", "posts")


ORACLE["normalize_query"] = f"SELECT doc_id, {X.normalize_query('text')} AS normalized FROM documents"
ORACLE["parse_price"] = f"SELECT doc_id, {X.parse_price('text')} AS price_nok FROM documents"
ORACLE["listing_id"] = f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN {X.listing_id_from_url('url')}
WHEN 1 THEN CAST(100000000 + page_id AS VARCHAR) ELSE CAST(500000 + page_id AS VARCHAR) END AS listing_id FROM pages"""

# --- table maintenance -----------------------------------------------------


def _latest_state(name: str, src: str) -> None:
    """CTE ``name``: listing state from observation rows of CTE ``src``."""
    cte(f"{name}_last", f"""
SELECT * FROM (
  SELECT o.*, row_number() OVER (PARTITION BY id, query ORDER BY scraped_at DESC, seq DESC) AS rn
  FROM {src} o) t WHERE rn = 1""", (src,))
    cte(f"{name}_base", f"""
SELECT l.id, l.query, l.price_nok, l.scraped_at, l.seq,
       l.scan_day = m.last_day AS is_active,
       'listing ' || l.id AS title, {X.q('https://www.finn.no/item/')} || l.id AS url,
       {SP.LISTING_TEXT} AS description
FROM {name}_last l JOIN (SELECT query, max(scan_day) AS last_day FROM {src} GROUP BY query) m
  USING (query)""", (f"{name}_last",))
    cte(f"{name}_ps", f"""
SELECT b.*, {X.price_score('b.price_nok', 'm.median')} AS price_score
FROM {name}_base b LEFT JOIN (
  SELECT query, quantile_cont(price_nok, 0.5) FILTER (WHERE price_nok > 0) AS median
  FROM {name}_base GROUP BY query) m USING (query)""", (f"{name}_base",))
    cte(name, f"""
SELECT *, {X.composite_score('title', 'description', 'price_score')} AS composite_score
FROM {name}_ps""", (f"{name}_ps",))


cte("obs_split", """
SELECT o.*, o.scan_day < m.last_day AS is_before
FROM obs o JOIN (SELECT query, max(scan_day) AS last_day FROM obs GROUP BY query) m USING (query)""",
    ("obs",))
cte("obs_before", "SELECT * EXCLUDE (is_before) FROM obs_split WHERE is_before", ("obs_split",))
cte("batch", f"""
SELECT id, query, 'listing ' || id AS title, price_nok, {X.q('https://www.finn.no/item/')} || id AS url,
       scraped_at, {SP.LISTING_TEXT} AS description, CAST(NULL AS DOUBLE) AS price_score,
       CAST(NULL AS DOUBLE) AS composite_score, seq
FROM obs_split WHERE NOT is_before""", ("obs_split",))
_latest_state("tb", "obs_before")
cte("hist_before", """
SELECT listing_id, query, price, seen_at, seq FROM (
  SELECT id AS listing_id, query, price_nok AS price, scraped_at AS seen_at, seq,
         lag(price_nok) OVER (PARTITION BY id, query ORDER BY scraped_at, seq) AS prev
  FROM obs_before WHERE price_nok <> 0) t
WHERE prev IS NULL OR prev <> price""", ("obs_before",))

cte("upserted", """
SELECT coalesce(t.id, b.id) AS id, coalesce(t.query, b.query) AS query,
       CASE WHEN b.id IS NOT NULL THEN b.title ELSE t.title END AS title,
       CASE WHEN b.id IS NOT NULL THEN b.price_nok ELSE t.price_nok END AS price_nok,
       CASE WHEN b.id IS NOT NULL THEN b.url ELSE t.url END AS url,
       CASE WHEN b.id IS NOT NULL THEN b.scraped_at ELSE t.scraped_at END AS scraped_at,
       CASE WHEN b.id IS NOT NULL THEN b.description ELSE t.description END AS description,
       CASE WHEN b.id IS NOT NULL THEN b.price_score ELSE t.price_score END AS price_score,
       coalesce(b.composite_score, t.composite_score) AS composite_score,
       CASE WHEN b.id IS NOT NULL THEN true WHEN s.query IS NOT NULL THEN false
            ELSE coalesce(t.is_active, true) END AS is_active
FROM tb t
FULL OUTER JOIN (
  SELECT * EXCLUDE (rn, composite_score), ck AS composite_score FROM (
    SELECT *, row_number() OVER (PARTITION BY id, query ORDER BY seq DESC) AS rn,
           arg_max(composite_score, seq) FILTER (WHERE composite_score IS NOT NULL)
             OVER (PARTITION BY id, query) AS ck
    FROM batch) x WHERE rn = 1) b
  ON t.id = b.id AND t.query = b.query
LEFT JOIN (SELECT DISTINCT query FROM batch) s ON s.query = t.query""", ("tb", "batch"))

_UPSERT_COLS = ("id, query, title, price_nok, url, scraped_at, description, price_score, "
                "composite_score, is_active")
ORACLE["upsert_listings"] = build_sql(f"SELECT {_UPSERT_COLS} FROM upserted", "upserted")
ORACLE["deactivate_missing"] = build_sql(f"""
SELECT {_UPSERT_COLS} FROM upserted u
WHERE NOT u.is_active AND EXISTS (
  SELECT 1 FROM tb t WHERE t.id = u.id AND t.query = u.query AND coalesce(t.is_active, true))""",
    "upserted", "tb")

ORACLE["append_history"] = build_sql("""
SELECT listing_id, query, price, seen_at, seq FROM (
  SELECT u.*, lag(price) OVER (PARTITION BY listing_id, query ORDER BY _new, seq) AS prev
  FROM (
    SELECT listing_id, query, price, seen_at, seq, 0 AS _new FROM (
      SELECT h.*, row_number() OVER (PARTITION BY listing_id, query
                                     ORDER BY seen_at DESC, seq DESC) AS rn
      FROM hist_before h
      WHERE EXISTS (SELECT 1 FROM batch b WHERE b.price_nok <> 0
                    AND b.id = h.listing_id AND b.query = h.query)) t WHERE rn = 1
    UNION ALL
    SELECT id, query, price_nok, scraped_at, seq, 1 FROM batch WHERE price_nok <> 0) u) v
WHERE _new = 1 AND (prev IS NULL OR prev <> price)""", "hist_before", "batch")

_CUT = f"({KP.NOW_SQL} - INTERVAL {KP.RETENTION_DAYS} DAY)"
cte("stale", f"SELECT id, query FROM listings_v WHERE NOT coalesce(is_active, true) "
             f"AND scraped_at < {_CUT}", ("listings_v",))
ORACLE["prune_listings"] = build_sql(
    "SELECT id, query, price_nok, scraped_at, is_active FROM listings_v l "
    "WHERE NOT EXISTS (SELECT 1 FROM stale s WHERE s.id = l.id AND s.query = l.query)",
    "listings_v", "stale")
ORACLE["prune_history"] = build_sql(
    "SELECT listing_id, query, price, seen_at, seq FROM hist h "
    "WHERE NOT EXISTS (SELECT 1 FROM stale s WHERE s.id = h.listing_id AND s.query = h.query)",
    "hist", "stale")
ORACLE["prune_counts"] = build_sql(
    "SELECT 'listings' AS \"table\", count(*) AS deleted FROM stale UNION ALL "
    "SELECT 'price_history', count(*) FROM hist h "
    "WHERE EXISTS (SELECT 1 FROM stale s WHERE s.id = h.listing_id AND s.query = h.query)",
    "hist", "stale")

# --- read models -----------------------------------------------------------

ORACLE["saved_searches"] = build_sql(
    "SELECT query, count(*) AS n_active, max(scraped_at) AS last_seen FROM listings_v "
    "WHERE coalesce(is_active, true) GROUP BY query ORDER BY last_seen DESC, query", "listings_v")

ORACLE["search_freshness"] = build_sql(
    f"SELECT query, max(scraped_at) AS last_scan, "
    f"coalesce(max(scraped_at) >= {KP.NOW_SQL} - INTERVAL {int(KP.CACHE_TTL_HOURS * 3600)} SECOND, false) AS fresh "
    f"FROM (SELECT * REPLACE (query || '/' || CAST(CAST(id AS BIGINT) % 50 AS VARCHAR) AS query) FROM listings_v) t "
    f"WHERE coalesce(is_active, true) GROUP BY query", "listings_v")

ORACLE["best_deals"] = build_sql(
    f"SELECT id, query, price_nok, price_score FROM listings_v "
    f"WHERE price_score IS NOT NULL AND coalesce(is_active, true) "
    f"ORDER BY price_score, query, id LIMIT {KP.DEALS_LIMIT}", "listings_v")

ORACLE["listings_by_query"] = build_sql(
    f"SELECT id, query, price_nok, price_score, is_active FROM listings_v "
    f"WHERE query = {X.q(KP.EXPORT_QUERY)} ORDER BY price_score NULLS FIRST, id", "listings_v")

# --- reviews ---------------------------------------------------------------


def _py_int(e: str) -> str:
    s = X.py_strip(f"CAST({e} AS VARCHAR)")
    w = f"regexp_extract({s}, '^([+-]?[0-9]+)([.][0-9]+)?$', 1)"
    return (f"(CASE WHEN {w} <> '' THEN coalesce(TRY_CAST({w} AS BIGINT), CASE WHEN starts_with({w}, '-') "
            f"THEN CAST('-9223372036854775808' AS BIGINT) ELSE 9223372036854775807 END) END)")


cte("sanitized", f"""
SELECT id, query, CAST(greatest(1, least(10, c)) AS INTEGER) AS condition_score,
       CAST(CASE WHEN b BETWEEN 1 AND 100 THEN b END AS INTEGER) AS battery_pct,
       coalesce(red_flags, CAST([] AS VARCHAR[])) AS red_flags, coalesce(summary, '') AS summary
FROM (SELECT r.*, {_py_int('r.condition_score')} AS c, {_py_int('r.battery_pct')} AS b
      FROM reviews r) t
WHERE c IS NOT NULL AND (battery_pct IS NULL OR b IS NOT NULL)""", ("reviews",))

cte("merged", """
SELECT p.*, s.condition_score, s.battery_pct AS r_battery, s.red_flags, s.summary
FROM posts_scored p LEFT JOIN sanitized s USING (id, query)""", ("posts_scored", "sanitized"))

cte("reviewed", f"""
SELECT * EXCLUDE (r_battery), r_battery AS battery_pct,
       {X.composite_score('title', 'description', 'price_score', 'r_battery')} AS composite_score
FROM merged""", ("merged",))

ORACLE["sanitize_assessments"] = build_sql(
    "SELECT id, query, condition_score, battery_pct, array_to_string(red_flags, '; ') AS red_flags, "
    "summary FROM sanitized", "sanitized")

ORACLE["merge_assessments"] = build_sql(
    "SELECT id, query, price_score, condition_score, r_battery AS battery_pct FROM merged", "merged")

ORACLE["rescore_reviewed"] = build_sql(
    "SELECT id, query, battery_pct, composite_score FROM reviewed", "reviewed")

ORACLE["top_reviewed"] = build_sql(f"""
SELECT query, id, rank, composite_score FROM (
  SELECT r.*, row_number() OVER (PARTITION BY query
           ORDER BY coalesce(composite_score, CAST(0 AS DOUBLE)) DESC, id) AS rank
  FROM reviewed r WHERE condition_score IS NOT NULL OR summary <> '') t
WHERE rank <= {KP.CANDIDATE_LIMIT}""", "reviewed")

ORACLE["condition_bands"] = build_sql(
    f"SELECT id, query, price_score, condition_score, {X.price_band('price_score')} AS price_band, "
    f"{X.condition_band('condition_score')} AS condition_band FROM reviewed", "reviewed")


def _candidates_sql(src: str, limit: int) -> str:
    """Select-candidates rule over CTE ``src`` (needs price_score, composite_score)."""
    thr = "CAST(-60.0 AS DOUBLE)"
    return f"""
SELECT * FROM (
  SELECT c.*, row_number() OVER (
           PARTITION BY query
           ORDER BY CASE WHEN f.use_cs THEN -coalesce(composite_score, CAST(0 AS DOUBLE))
                         ELSE price_score END, price_score, id) AS rank
  FROM cand_{src} c JOIN (SELECT query, bool_or(composite_score IS NOT NULL) AS use_cs
                          FROM cand_{src} GROUP BY query) f USING (query)) t
WHERE rank <= {limit}"""


def _candidate_ctes(src: str) -> None:
    thr = "CAST(-60.0 AS DOUBLE)"
    cte(f"cand_{src}", f"""
SELECT s.* FROM {src} s JOIN (
  SELECT query, bool_or(price_score > {thr}) AS has_safe FROM {src}
  WHERE price_score IS NOT NULL GROUP BY query) f USING (query)
WHERE s.price_score IS NOT NULL AND (s.price_score > {thr} OR NOT f.has_safe)""", (src,))


cte("posts_cs", f"SELECT *, {X.composite_score('title', 'description', 'price_score')} "
                f"AS composite_score FROM posts_scored", ("posts_scored",))
_candidate_ctes("posts_cs")
cte("post_candidates", _candidates_sql("posts_cs", KP.CANDIDATE_LIMIT), ("cand_posts_cs",))

ORACLE["review_worklist"] = build_sql("""
SELECT id, query, title, price_nok, coalesce(nullif(source, ''), '-') AS location,
       coalesce(nullif(description, ''), '(no description)') AS description,
       CAST((least(doc_id % 12, 8) + 2) // 3 AS INTEGER) AS n_images
FROM post_candidates""", "post_candidates")

cte("stored_flat", """
SELECT CAST(l.doc_id AS VARCHAR) AS id, d.lang AS query,
       CAST(CASE WHEN l.quality = 1 THEN 8 WHEN l.toxic = 1 THEN 0 END AS INTEGER) AS condition_score,
       CAST(l.doc_id % 101 AS INTEGER) AS battery_pct,
       CASE WHEN l.toxic = 1 THEN '' ELSE 'quality ' || CAST(l.quality AS VARCHAR) END AS ai_summary,
       CASE WHEN l.toxic = 1 THEN '["toxic language", "check seller"]'
            WHEN l.quality = 0 THEN 'not json' WHEN l.quality = 1 THEN '[]' END AS ai_red_flags
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")

_FLAGS = ("(CASE WHEN json_valid(ai_red_flags) AND json_type(ai_red_flags) = 'ARRAY' "
          "THEN from_json(ai_red_flags, '[\"VARCHAR\"]') ELSE CAST([] AS VARCHAR[]) END)")
ORACLE["stored_reports"] = build_sql(f"""
SELECT id, query, ex AS has_report,
       CASE WHEN ex THEN CAST(coalesce(nullif(condition_score, 0), 5) AS INTEGER) END AS condition_score,
       CASE WHEN ex THEN battery_pct END AS battery_pct,
       CASE WHEN ex THEN array_to_string(flags, '; ') END AS red_flags,
       CASE WHEN ex THEN coalesce(ai_summary, '') END AS summary
FROM (SELECT *, coalesce(condition_score IS NOT NULL OR ai_summary <> '', false) AS ex,
             {_FLAGS} AS flags FROM stored_flat) t""", "stored_flat")

ORACLE["json_arrays"] = build_sql(f"""
SELECT id, query, CAST(len(flags) AS INTEGER) AS n_flags, CAST(to_json(flags) AS VARCHAR) AS flags_json
FROM (SELECT *, {_FLAGS} AS flags FROM stored_flat) t""", "stored_flat")

# --- export ----------------------------------------------------------------


def _guard(e: str) -> str:
    return (f"(CASE WHEN substr({e}, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) "
            f"THEN '''' || {e} ELSE {e} END)")


cte("export_src", """
SELECT r.id, r.query, r.title, r.price_nok, r.price_score, r.composite_score, r.condition_score,
       r.battery_pct, r.summary AS ai_summary,
       nullif(array_to_string(r.red_flags, '; '), '') AS red_flags,
       r.source AS location, 'https://www.finn.no/item/' || r.id AS url,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + r.doc_id * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S+00:00') AS scraped_at
FROM reviewed r""", ("reviewed",))

_TEXT_COLS = ("id", "query", "title", "ai_summary", "red_flags", "location", "url", "scraped_at")
_EXPORT = ("id", "query", "title", "price_nok", "price_score", "composite_score",
           "condition_score", "battery_pct", "ai_summary", "red_flags", "location", "url",
           "scraped_at")
ORACLE["export_rows"] = build_sql(
    "SELECT " + ", ".join(f"{_guard(c)} AS {c}" if c in _TEXT_COLS else c for c in _EXPORT)
    + " FROM export_src", "export_src")
ORACLE["export_json_rows"] = build_sql("SELECT " + ", ".join(_EXPORT) + " FROM export_src",
                                       "export_src")

# --- pages / URLs / scans --------------------------------------------------

from pricelens.sources import pages as PG  # noqa: E402
from pricelens.sources import standins as SI  # noqa: E402


# What the spliced cards must read as, stated from the ids.
cte("cards", f"""
SELECT page_id, query, CAST(page_num AS BIGINT) AS page_num, 0 AS pos,
       CAST(n AS VARCHAR) AS id,
       CASE k WHEN 0 THEN 'Ting ' || p || ' fra ' || {SP.HOST} WHEN 2 THEN 'Søker – ' || p WHEN 3 THEN 'Ting ' || p ELSE 'Uten kort ' || p END AS title,
       CAST(CASE k WHEN 0 THEN (page_id % 9 + 1) * 1000 + 500 WHEN 2 THEN page_id WHEN 3 THEN (page_id % 5 + 1) * 1000 ELSE page_id * 1000 END AS BIGINT) AS price_nok,
       'https://www.finn.no' || CASE k WHEN 2 THEN '/bap/forsale/ad.html?finnkode=' WHEN 3 THEN '/bap/' ELSE '/recommerce/forsale/item/' END || CAST(n AS VARCHAR) AS url,
       CASE k WHEN 0 THEN 'Oslo, ' || {SP.HOST} WHEN 2 THEN 'Bergen' WHEN 3 THEN 'Tromsø' END AS location,
       CASE k WHEN 0 THEN 'https://images.finncdn.no/dynamic/1x1/' || p || '.jpg' ELSE '' END AS image_urls,
       CASE k WHEN 0 THEN 'Pent brukt' ELSE '' END AS description
FROM (SELECT *, page_id % 6 AS k, CAST(page_id AS VARCHAR) AS p,
             page_id + CASE page_id % 6 WHEN 0 THEN 100000000 WHEN 2 THEN 123456789 WHEN 3 THEN 7000000 ELSE 200000000 END AS n FROM captured) t
WHERE k IN (0, 2, 3, 5)""", ("captured",))
ORACLE["page_cards"] = build_sql("SELECT * FROM cards", "cards")

cte("links", f"""
SELECT page_id, pos, href, abs_url, {X.safe_listing_url('abs_url')} AS safe_url FROM (
  SELECT page_id, pos, href, {X.absolute_url('href')} AS abs_url FROM (
    SELECT page_id, CAST(unnest(range(0, len(hs))) AS INTEGER) AS pos, unnest(hs) AS href
    FROM (SELECT page_id, regexp_extract_all(html, {X.q(SI.HREFS_RE)}, 1) AS hs FROM captured) a) b) c""", ("captured",))

ORACLE["page_links"] = build_sql(
    f"SELECT page_id, pos, href, abs_url, safe_url, "
    f"CASE WHEN safe_url IS NOT NULL THEN {X.listing_id_from_url('safe_url')} END AS listing_id "
    f"FROM links", "links")

ORACLE["safe_urls"] = (
    f"SELECT page_id, url, {X.url_scheme('url')} AS scheme, {X.url_host('url')} AS host, "
    f"{X.safe_listing_url('url', KP.PAGE_HOSTS_EXACT, KP.PAGE_HOST_SUFFIXES)} AS safe_url FROM pages")

ORACLE["safe_image_urls"] = build_sql(
    f"SELECT page_id, pos, abs_url, {X.image_url_allowed('abs_url')} AS allowed, "
    f"CASE WHEN {X.image_url_allowed('abs_url')} THEN abs_url END AS kept FROM links", "links")

_W = "(40 + (page_id * 7 + (i - 1) * 13) % 400)"
cte("img_cands", f"""
SELECT page_id, cands,
       CASE WHEN len(cands) > 0 THEN [cands[1].src] ELSE CAST([] AS VARCHAR[]) END AS existing
FROM (SELECT page_id, list_transform(list_concat(hs, list_concat(hs, hs)),
        lambda h, i: {{'src': CASE WHEN (i - 1) % 4 = 3 THEN 'https://evil.example.org/dynamic/' ELSE {X.q(SI.CDN_PREFIX)} END || CAST({_W} AS VARCHAR) || 'x' ||
                              CAST({_W} AS VARCHAR) || 'c' || h,
                      'width': CAST({_W} AS INTEGER)}}) AS cands
      FROM (SELECT page_id, regexp_extract_all(html, {X.q(SI.HREFS_RE)}, 1) AS hs FROM pages) h) t""")

ORACLE["image_url_upgrade"] = build_sql(
    f"SELECT page_id, pos, src, {X.upgrade_image_url('src')} AS upgraded FROM ("
    f"SELECT page_id, CAST(unnest(range(0, len(cands))) AS INTEGER) AS pos, "
    f"unnest(cands).src AS src FROM img_cands) t", "img_cands")

_UP = X.upgrade_image_url("c.src")
_TAKE = (f"coalesce(c.src, '') <> '' AND NOT list_contains(acc.seen, c.src) "
         f"AND NOT coalesce(c.width > 0 AND c.width < 100, false) AND {X.image_url_allowed(_UP)}")
cte("gallery", f"""
SELECT page_id, cands, existing,
       list_reduce(cands, lambda acc, c: CASE WHEN {_TAKE}
                   THEN {{'seen': list_append(acc.seen, {_UP}), 'out': list_append(acc.out, {_UP})}}
                   ELSE acc END,
                   {{'seen': existing, 'out': CAST([] AS VARCHAR[])}}).out AS g
FROM img_cands""", ("img_cands",))

ORACLE["gallery_images"] = build_sql("""
SELECT page_id, CAST(len(cands) AS INTEGER) AS n_candidates,
       CAST(len(imgs) AS INTEGER) AS n_images, array_to_string(imgs, ' ') AS images
FROM (SELECT *, CASE WHEN len(g) > 0 THEN g[1:8] ELSE existing END AS imgs FROM gallery) t""",
    "gallery")

cte("details", f"""
SELECT page_id,
       CASE page_id % 7 WHEN 0 THEN 'Selges fra ' || {SP.HOST} || ' som ny' WHEN 1 THEN 'Annonse ' || CAST(page_id AS VARCHAR) || ' fra ' || {SP.HOST}
         WHEN 2 THEN 'Lang tekst om ' || {SP.HOST} ELSE '' END AS detail_description,
       CASE page_id % 7 WHEN 0 THEN 'Bodø' WHEN 1 THEN 'Oslo' WHEN 2 THEN 'Alta' WHEN 3 THEN 'Voss' END AS detail_location
FROM pages""")

ORACLE["enrich_details"] = build_sql("""
SELECT CAST(d.doc_id AS VARCHAR) AS id, d.lang AS query,
       length(coalesce(nullif(x.detail_description, ''), d.text)) AS description_len,
       coalesce(CASE WHEN d.doc_id % 2 = 0 THEN nullif(d.source, '') END, x.detail_location) AS location
FROM documents d LEFT JOIN details x ON x.page_id = d.doc_id""", "details")

cte("scan_cards", """
SELECT query || '@' || CAST(scan_day AS VARCHAR) AS scan_id, id,
       CAST(hour(scraped_at) + 1 AS INTEGER) AS page_num, seq AS pos, price_nok
FROM obs""", ("obs",))
cte("scan_new", """
SELECT scan_id, page_num, count(*) AS new_ids FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id, id ORDER BY page_num, pos) AS rn
  FROM scan_cards) t WHERE rn = 1 GROUP BY scan_id, page_num""", ("scan_cards",))
cte("scan_comp", """
SELECT scan_id, bool_or(page_num > 1 AND new_ids = 0) AS complete,
       coalesce(min(CASE WHEN page_num > 1 AND new_ids = 0 THEN page_num END), max(page_num)) AS stop_page
FROM (SELECT p.scan_id, p.page_num, coalesce(n.new_ids, 0) AS new_ids
      FROM (SELECT DISTINCT scan_id, page_num FROM scan_cards) p
      LEFT JOIN scan_new n USING (scan_id, page_num)) t
GROUP BY scan_id""", ("scan_cards", "scan_new"))
ORACLE["scan_complete"] = build_sql("SELECT scan_id, complete, stop_page FROM scan_comp", "scan_comp")
ORACLE["dedupe_scan"] = build_sql("""
SELECT scan_id, id, page_num, pos, price_nok FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.scan_id, c.id ORDER BY c.page_num, c.pos) AS rn
  FROM scan_cards c JOIN scan_comp s USING (scan_id) WHERE c.page_num <= s.stop_page) t
WHERE rn = 1""", "scan_cards", "scan_comp")

# --- streaming twins -------------------------------------------------------

ORACLE["scan_activity"] = build_sql("""
SELECT query, date_trunc('day', scraped_at) AS window_start,
       date_trunc('day', scraped_at) + INTERVAL 1 DAY AS window_end, count(*) AS n_obs
FROM obs GROUP BY query, date_trunc('day', scraped_at)
HAVING date_trunc('day', scraped_at) + INTERVAL 1 DAY
       <= (SELECT max(scraped_at) FROM obs) - INTERVAL 3600 SECOND""", "obs")

# --- end-to-end scan flow --------------------------------------------------

cte("ss_kept", f"""
SELECT * FROM (
  SELECT id, {X.normalize_query('query')} AS query, title, price_nok, description, seq,
         row_number() OVER (PARTITION BY id, {X.normalize_query('query')} ORDER BY seq) AS rn
  FROM batch) b
WHERE rn = 1 AND NOT {_blacklisted('title', BLACKLIST_TERMS)}
  AND NOT coalesce(price_nok < {KP.OBS_MIN_PRICE}, false)""", ("batch",))
cte("ss_scored", f"""
SELECT k.*, {X.price_score('k.price_nok', 'm.median')} AS price_score FROM ss_kept k LEFT JOIN (
  SELECT query, quantile_cont(price_nok, 0.5) FILTER (WHERE price_nok > 0) AS median
  FROM ss_kept GROUP BY query) m USING (query)""", ("ss_kept",))
cte("ss_cs", f"SELECT *, {X.composite_score('title', 'description', 'price_score')} AS composite_score "
             f"FROM ss_scored", ("ss_scored",))
_candidate_ctes("ss_cs")
cte("ss_cands", _candidates_sql("ss_cs", KP.CANDIDATE_LIMIT), ("cand_ss_cs",))
ORACLE["scan_scoring"] = build_sql("""
SELECT s.id, s.query, s.seq, s.price_nok, s.price_score, s.composite_score, c.rank
FROM ss_cs s LEFT JOIN ss_cands c ON c.id = s.id AND c.query = s.query""", "ss_cs", "ss_cands")

cte("ps_loaded", f"SELECT DISTINCT query, page_num FROM captured WHERE page_num <= {KP.SCAN_PAGES}", ("captured",))
cte("ps_comp", """
SELECT query, bool_or(page_num > 1 AND n = 0) AS complete,
       coalesce(min(page_num) FILTER (WHERE page_num > 1 AND n = 0), max(page_num)) AS stop_page
FROM (SELECT l.query, l.page_num, count(c.id) AS n FROM ps_loaded l
      LEFT JOIN (SELECT query, id, min(page_num) AS page_num FROM cards GROUP BY query, id) c USING (query, page_num) GROUP BY ALL) t
GROUP BY query""", ("ps_loaded", "cards"))
cte("ps_kept", f"""
SELECT c.*, p.complete FROM cards c JOIN ps_comp p USING (query)
WHERE c.page_num <= p.stop_page AND c.page_num <= {KP.SCAN_PAGES} AND NOT {_blacklisted('title', BLACKLIST_TERMS)}
  AND NOT coalesce(price_nok < 500, false)""", ("cards", "ps_comp"))
cte("ps_scored", f"""
SELECT k.*, {X.price_score('k.price_nok', 'm.median')} AS price_score FROM ps_kept k LEFT JOIN (
  SELECT query, quantile_cont(price_nok, 0.5) FILTER (WHERE price_nok > 0) AS median
  FROM ps_kept GROUP BY query) m USING (query)""", ("ps_kept",))
cte("ps_cs", f"SELECT *, {X.composite_score('title', 'description', 'price_score')} AS composite_score FROM ps_scored", ("ps_scored",))
_candidate_ctes("ps_cs")
cte("ps_cands", _candidates_sql("ps_cs", KP.CANDIDATE_LIMIT), ("cand_ps_cs",))
cte("ps_rich", """
SELECT s.* REPLACE (CASE WHEN c.rank IS NOT NULL THEN coalesce(nullif(d.detail_description, ''), s.description) ELSE s.description END AS description,
                    CASE WHEN c.rank IS NOT NULL THEN coalesce(nullif(s.location, ''), d.detail_location) ELSE s.location END AS location), c.rank
FROM ps_cs s LEFT JOIN ps_cands c ON c.id = s.id AND c.query = s.query LEFT JOIN details d ON d.page_id = s.page_id""", ("ps_cs", "ps_cands", "details"))
ORACLE["page_scan_scoring"] = build_sql(f"""
SELECT query, id, page_num, title, price_nok, price_score,
       CASE WHEN rank IS NOT NULL THEN {X.composite_score('title', 'description', 'price_score')} ELSE composite_score END AS composite_score,
       rank, location, CAST(length(description) AS INTEGER) AS description_len, complete
FROM ps_rich""", "ps_rich")

cte("ds_cs", f"""
SELECT *, {X.composite_score('title', 'description', 'price_score')} AS composite_score FROM (
  SELECT s.* REPLACE (coalesce(nullif(d.detail_description, ''), s.description) AS description,
                      coalesce(nullif(s.location, ''), d.detail_location) AS location)
  FROM ps_scored s LEFT JOIN details d ON d.page_id = s.page_id) t""", ("ps_scored", "details"))
_candidate_ctes("ds_cs")
cte("ds_cands", _candidates_sql("ds_cs", KP.CANDIDATE_LIMIT), ("cand_ds_cs",))
ORACLE["deep_scan_scoring"] = build_sql("""
SELECT s.query, s.id, s.page_num, s.title, s.price_nok, s.price_score, s.composite_score, c.rank, s.location,
       CAST(length(s.description) AS INTEGER) AS description_len, s.complete
FROM ds_cs s LEFT JOIN ds_cands c ON c.id = s.id AND c.query = s.query""", "ds_cs", "ds_cands")

ORACLE["timestamp_text"] = """
SELECT event_id, ts_text,
       epoch_us(CAST(CASE WHEN regexp_matches(ts_text, '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN ts_text
                          ELSE ts_text || 'Z' END AS TIMESTAMPTZ)) AS epoch_us
FROM (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')
             || CASE WHEN microsecond(ts) <> 0 THEN '.' || strftime(ts, '%f') ELSE '' END
             || CASE WHEN event_id % 2 = 0 THEN '+00:00' ELSE '' END AS ts_text FROM events) t"""

ORACLE["drops_for_query"] = build_sql(
    _DROPS.replace("ORDER BY drop_pct DESC", f"WHERE d.query = {X.q(KP.EXPORT_QUERY)} ORDER BY drop_pct DESC"),
    "drops", "listings_v")
