"""SQL text of the views in ``bellwether.sources.views``, for the comparison queries."""

from __future__ import annotations

_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": ((), """
        SELECT CAST(l_suppkey AS VARCHAR) AS ticker,
               CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
               arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, k) AS close, sum(l_quantity) AS volume
        FROM (SELECT *, 100.0::DOUBLE + floor(l_extendedprice) / 10000.0::DOUBLE AS price,
                     row(l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem)
        GROUP BY 1, 2"""),
    "panel": (("bars",), """
        SELECT *, lag(close) OVER w AS prev_close, lag(date) OVER w AS prev_date,
               close / lag(close) OVER w - 1 AS ret, open / lag(close) OVER w - 1 AS gap,
               (high - low) / nullif(close, 0) AS hl,
               row_number() OVER w AS rn
        FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)"""),
    "scores": (("panel",), """
        SELECT ticker, date, open AS o, high AS h, low AS l, close AS c, volume AS vol, gap,
               phl / (0.03::DOUBLE + phl) AS score, next_o, gap AS gap_open
        FROM (SELECT *, lag(hl) OVER w AS phl, lead(open) OVER w AS next_o
              FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date))
        WHERE phl IS NOT NULL"""),
    "flows": ((), """
        SELECT CAST(l_suppkey AS VARCHAR) AS ticker,
               CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
               coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag <> 'R'), 0) AS buy,
               coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 0) AS sell
        FROM lineitem GROUP BY 1, 2"""),
    "caps": (("bars",), """
        SELECT b.ticker, b.date, (floor(abs(s_acctbal)) + 1) * b.close AS market_cap
        FROM bars b JOIN supplier ON b.ticker = CAST(s_suppkey AS VARCHAR)"""),
    "ticks": ((), """
        SELECT event_id, event_type AS ticker, ts, 100.0::DOUBLE + value / 10.0::DOUBLE AS price,
               1 + user_id % 10 AS qty FROM events"""),
    "bars_intraday": (("ticks",), """
        SELECT *, row_number() OVER (PARTITION BY ticker, day ORDER BY ts) AS bar_ix FROM (
          SELECT ticker, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS ts0,
                 arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low,
                 arg_max(price, row(ts, event_id)) AS close, sum(qty) AS volume
          FROM ticks GROUP BY 1, 2, 3) AS g(ticker, day, ts, open, high, low, close, volume)"""),
    "daily": (("ticks",), """
        SELECT ticker, CAST(ts AS DATE) AS date,
               arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, row(ts, event_id)) AS close, sum(qty) AS volume
        FROM ticks WHERE dayofweek(ts) BETWEEN 1 AND 5 GROUP BY 1, 2"""),
    "calendar": (("daily",), """
        SELECT td, row_number() OVER (ORDER BY td) - 1 AS pos,
               td + INTERVAL 9 HOUR AS open_ts, td + INTERVAL 930 MINUTE AS close_ts
        FROM (SELECT DISTINCT date AS td FROM daily)"""),
    "news": ((), """
        SELECT doc_id AS news_id,
               ['click', 'error', 'purchase', 'signup', 'view'][1 + doc_id % 5] AS ticker,
               TIMESTAMP '2024-01-01' + to_seconds((doc_id * 7919) % 2592000) AS published_at,
               text AS title FROM documents"""),
    "sentiment": ((), """
        SELECT doc_id AS news_id, CAST(quality - toxic AS DOUBLE) AS sent FROM labels"""),
    "news_vec": ((), "SELECT vec_id AS news_id, embedding AS vec FROM embeddings"),
    "scored_news": (("news", "sentiment"), """
        SELECT n.news_id, ticker, published_at, sent FROM news n LEFT JOIN sentiment USING (news_id)"""),
    "sessioned": (("scored_news", "calendar"), """
        SELECT n.*, eff.td AS eff, info.td AS info, eff.td = info.td AS fresh,
               eff.pos AS eff_pos, info.pos AS info_pos,
               n.published_at >= info.open_ts AS in_session
        FROM scored_news n
        ASOF LEFT JOIN calendar eff ON n.published_at <= eff.open_ts
        ASOF LEFT JOIN calendar info ON n.published_at <= info.close_ts"""),
    "tokens": ((), """
        SELECT doc_id AS news_id, pos, toks[pos] AS form FROM (
          SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS pos FROM (
            SELECT doc_id, [x for x in regexp_extract_all(lower(text), '[a-z][a-z0-9''\\-]*')
                            if length(x) >= 2] AS toks FROM documents))"""),
    "aliases": (("tokens",), """
        SELECT alias, rk, ['click', 'error', 'purchase', 'signup', 'view'][1 + (rk - 1) % 5] AS ticker FROM (
          SELECT alias, row_number() OVER (ORDER BY c DESC, alias) AS rk FROM (
            SELECT alias, count(DISTINCT news_id) AS c FROM (
              SELECT news_id, unnest([a, CASE WHEN length(b) >= 5 THEN a || ' ' || b END]) AS alias FROM (
                SELECT news_id, form AS a, lead(form) OVER (PARTITION BY news_id ORDER BY pos) AS b FROM tokens) WHERE length(a) >= 5)
            WHERE alias IS NOT NULL GROUP BY alias), (SELECT count(*) AS n FROM documents)
          WHERE 100 * c >= 3 * n AND (100 * c <= 6 * n OR contains(alias, ' ')))"""),
    "vocab": (("tokens",), """
        SELECT form, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, form) AS word_id
        FROM tokens GROUP BY form HAVING count(*) >= 5"""),
    "words": (("vocab", "news_vec"), """
        SELECT form, word_id, vec FROM vocab JOIN news_vec ON (word_id - 1) % (SELECT count(*) FROM news_vec) = news_id"""),
    "vector_news": (("news", "news_vec"), """
        SELECT n.news_id, ticker, published_at, vec FROM news n JOIN news_vec USING (news_id)"""),
    "vector_scored": (("vector_news", "sentiment"), """
        SELECT v.*, coalesce(sent, 0) AS sent FROM vector_news v LEFT JOIN sentiment USING (news_id)"""),
    "phrases": (("tagged",), """
        SELECT *, sum(CASE WHEN tag = 'N' AND prev <> 'N' THEN 1 ELSE 0 END) OVER
                 (PARTITION BY news_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS np
        FROM (SELECT *, coalesce(lag(tag) OVER (PARTITION BY news_id ORDER BY pos), '') AS prev FROM tagged)"""),
    "triples": (("phrases", "news"), """
        SELECT t.*, n.ticker, n.published_at, t.o1[-1] || '|' || t.p[1] || '|' || t.o2[-1] AS key FROM (
          WITH nps AS (SELECT news_id, np, list(form ORDER BY pos) AS words FROM phrases WHERE tag = 'N' GROUP BY 1, 2),
          pr AS (SELECT news_id, arg_max(tag, pos) AS ptag, arg_max(form, pos) AS pform, arg_max(np, pos) AS pnp
                 FROM phrases WHERE tag = 'V' OR (tag = 'A' AND prev = 'N' AND np >= 0) GROUP BY 1),
          mk AS (SELECT news_id, max(np) + 1 AS n,
                   coalesce(arg_min(np, pos) FILTER (WHERE tag = 'S' AND np >= 0), 0) AS o1i,
                   coalesce(arg_max(np, pos) FILTER (WHERE tag = 'O' AND np >= 0), max(np)) AS om
                 FROM phrases GROUP BY 1),
          ix AS (SELECT news_id, n, o1i, CASE WHEN om <> o1i THEN om WHEN o1i <> n - 1 THEN n - 1 ELSE 0 END AS o2i
                 FROM mk WHERE n >= 2)
          SELECT ix.news_id, a.words AS o1, CASE WHEN ptag = 'V' THEN [pform] ELSE c.words END AS p, b.words AS o2
          FROM ix JOIN pr USING (news_id)
          JOIN nps a ON a.news_id = ix.news_id AND a.np = o1i JOIN nps b ON b.news_id = ix.news_id AND b.np = o2i
          LEFT JOIN nps c ON c.news_id = ix.news_id AND c.np = pnp) t JOIN news n USING (news_id)
        WHERE t.o1 <> t.p AND t.o2 <> t.p AND t.o1 <> t.o2"""),
    "links": (("news", "aliases"), """
        SELECT DISTINCT a.ticker, n.news_id FROM news n JOIN aliases a ON contains(n.title, a.alias)"""),
    "novelty": (("vector_scored",), """
        SELECT a.ticker, a.news_id, a.published_at, a.sent, coalesce(1 - max(sim), 1) AS nov, count(sim) AS n7,
               coalesce(avg(CASE WHEN sim > 0.8 THEN 1.0 ELSE 0.0 END) FILTER (WHERE sim IS NOT NULL), 0) AS simfrac
        FROM vector_scored a LEFT JOIN LATERAL (
          SELECT list_cosine_similarity(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])) AS sim FROM vector_scored b
          WHERE a.ticker = b.ticker AND b.published_at >= a.published_at - INTERVAL 7 DAY
            AND (b.published_at < a.published_at OR (b.published_at = a.published_at AND b.news_id < a.news_id))) ON true
        GROUP BY 1, 2, 3, 4"""),
    "daily_panel": (("daily",), """
        SELECT *, lag(close) OVER w AS prev_close, lag(date) OVER w AS prev_date, lag(date, 2) OVER w AS pp_date,
               close / lag(close) OVER w - 1 AS ret, open / lag(close) OVER w - 1 AS gap,
               (high - low) / nullif(close, 0) AS hl, row_number() OVER w AS rn
        FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY date)"""),
    "hit_rows": (("panel",), """
        SELECT * FROM (
          SELECT *, CASE WHEN high >= open * 1.05::DOUBLE AND open > 0 THEN 1 ELSE 0 END AS up5,
            CASE WHEN low <= open * 0.95::DOUBLE AND open > 0 THEN 1 ELSE 0 END AS dn5,
            avg(hl) OVER f AS hl20,
            CASE WHEN rn > 3 THEN stddev_pop(coalesce(ret, 0)) OVER f ELSE 0 END AS std20,
            coalesce(lag(hl) OVER w, 0) AS hl_prev, abs(lag(coalesce(ret, 0)) OVER w) AS absr1_prev
          FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date),
            f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
        WHERE open > 0 AND volume > 0 AND prev_close > 0 AND gap < 0.295 AND rn > 31"""),
    "tagged": (("tokens",), """
        SELECT news_id, pos, form, ['N', 'N', 'S', 'O', 'V', 'A'][1 + length(form) % 6] AS tag FROM tokens"""),
}


def with_views(names: list[str], steps: list[str], final: str) -> str:
    """``WITH`` the named views, in dependency order, then the query's own steps."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for d in _VIEWS[name][0]:
            visit(d)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({_VIEWS[n][1].strip()})" for n in ordered] + steps
    return "WITH " + ",\n".join(parts) + "\n" + final
