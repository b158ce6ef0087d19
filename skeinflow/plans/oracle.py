"""SQL that states the plans' results independently, for the DuckDB dialect: named relations, joined as needed."""

from __future__ import annotations

import re

from skeinflow.functions.text import EMAIL, NEGATIVE, PHONE, POSITIVE
from skeinflow.plans.dims import FILING_TYPES
from skeinflow.plans.panel import PCS, RATIOS

_KEY = "md5(lower(trim({})))".format

#: Relations in order; each may use those before it.
RELATIONS: dict[str, str] = {
    "bars": """
        SELECT n_name AS symbol, CAST(o_orderdate AS DATE) AS trade_date, arg_min(o_totalprice, o_orderkey) AS open_px, max(o_totalprice) AS high_px,
               min(o_totalprice) AS low_px, arg_max(o_totalprice, o_orderkey) AS close_px, count(*) AS volume
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
    "rets": """
        SELECT *, CAST(round(close_px * 100) AS BIGINT) AS c, CASE WHEN before > 0 AND close_px > 0 THEN ln(close_px / before) END AS log_ret
        FROM (SELECT *, lag(close_px) OVER (PARTITION BY symbol ORDER BY trade_date) AS before FROM bars)""",
    "moved": """
        SELECT *, CAST(round(log_ret * 1e9) AS BIGINT) AS r,
          CAST(sum(c) OVER w5 AS DOUBLE) / count(c) OVER w5 / 100.0::DOUBLE AS sma_5, CAST(sum(c) OVER w20 AS DOUBLE) / count(c) OVER w20 / 100.0::DOUBLE AS sma_20,
          CAST(sum(c) OVER w50 AS DOUBLE) / count(c) OVER w50 / 100.0::DOUBLE AS sma_50, CAST(sum(c) OVER w12 AS DOUBLE) / count(c) OVER w12 / 100.0::DOUBLE AS ema_12,
          CAST(sum(c) OVER w26 AS DOUBLE) / count(c) OVER w26 / 100.0::DOUBLE AS ema_26
        FROM rets WINDOW w5 AS (PARTITION BY symbol ORDER BY trade_date ROWS 4 PRECEDING), w12 AS (PARTITION BY symbol ORDER BY trade_date ROWS 11 PRECEDING),
          w20 AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING), w26 AS (PARTITION BY symbol ORDER BY trade_date ROWS 25 PRECEDING), w50 AS (PARTITION BY symbol ORDER BY trade_date ROWS 49 PRECEDING)""",
    "spreads": """
        SELECT *, sqrt(CAST(count(c) OVER w * sum(c::HUGEINT * c) OVER w - (sum(c) OVER w) * (sum(c) OVER w) AS DOUBLE)) / count(c) OVER w / 100.0::DOUBLE AS sd_close,
          sqrt(CAST(count(r) OVER w * sum(r::HUGEINT * r) OVER w - (sum(r) OVER w) * (sum(r) OVER w) AS DOUBLE)) / nullif(count(r) OVER w, 0) / 1e9 AS sd_ret
        FROM moved WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING)""",
    "prices": f"""
        SELECT md5(symbol || '|' || trade_date::VARCHAR) AS price_key, md5(trade_date::VARCHAR) AS date_key, {_KEY('symbol')} AS company_key, symbol, trade_date, open_px, high_px, low_px, close_px, volume,
          round(log_ret, 6) AS log_ret_1d, sma_5, sma_20, sma_50, ema_12, ema_26, ema_12 - ema_26 AS macd_hist, round(CASE WHEN sd_close > 0 THEN (close_px - sma_20) / sd_close ELSE 0.0::DOUBLE END, 6) AS bb_z,
          CAST(NULL AS DOUBLE) AS rsi_14, round(sd_ret * sqrt(252.0::DOUBLE), 6) AS vol_20d, trade_date AS as_of_date FROM spreads""",
    "lines": """
        SELECT n_name AS symbol, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS filing_date, p * (100 - d) AS net, p * t AS duty, p * d AS rebate, l_returnflag AS flag, l_linestatus AS status
        FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS p, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t FROM lineitem)
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "sums": """
        SELECT symbol, filing_date, count(*) AS n, sum(net) AS revenue, coalesce(sum(net) FILTER (flag = 'N'), 0) AS kept, coalesce(sum(net) FILTER (flag = 'R'), 0) AS returned,
          coalesce(sum(net) FILTER (status = 'F'), 0) AS filled, sum(duty) AS duty, sum(rebate) AS rebate FROM lines GROUP BY ALL""",
    "statements": """
        SELECT symbol, filing_date, revenue, revenue - returned AS gross_profit, filled - duty AS operating_income, kept - returned AS net_income, filled - rebate AS ebitda,
          CASE WHEN n % 7 <> 0 THEN revenue + duty END AS total_assets, CASE WHEN n % 7 <> 0 THEN returned + duty END AS total_liabilities, CASE WHEN n % 7 <> 0 THEN revenue - 2 * returned END AS total_equity,
          CASE WHEN n % 7 <> 0 THEN duty END AS total_debt, CASE WHEN n % 7 <> 0 THEN rebate END AS cash, kept - rebate AS free_cash_flow, kept + duty AS operating_cash_flow FROM sums""",
    "ttm": """
        SELECT symbol, filing_date, """
    + ", ".join(f"CAST(sum({c}) OVER w AS DOUBLE) / 1e4 AS {c}_ttm" for c in ("revenue", "gross_profit", "operating_income", "net_income", "ebitda", "free_cash_flow", "operating_cash_flow"))
    + """, CAST(sum(total_assets) OVER w AS DOUBLE) / nullif(count(total_assets) OVER w, 0) / 1e4 AS avg_assets_ttm, CAST(sum(total_equity) OVER w AS DOUBLE) / nullif(count(total_equity) OVER w, 0) / 1e4 AS avg_equity_ttm, """
    + ", ".join(f"CAST({c} AS DOUBLE) / 1e4 AS {c}" for c in ("total_assets", "total_liabilities", "total_equity", "total_debt", "cash"))
    + """ FROM statements WINDOW w AS (PARTITION BY symbol ORDER BY filing_date ROWS 3 PRECEDING)""",
    "funds": f"""
        SELECT md5(symbol || '|' || filing_date::VARCHAR) AS fund_key, {_KEY('symbol')} AS company_key, *,
          CASE WHEN avg_equity_ttm > 0 THEN net_income_ttm / avg_equity_ttm END AS roe, CASE WHEN avg_assets_ttm > 0 THEN net_income_ttm / avg_assets_ttm END AS roa,
          CASE WHEN total_equity > 0 THEN total_debt / total_equity END AS debt_eq, CASE WHEN revenue_ttm > 0 THEN gross_profit_ttm / revenue_ttm END AS gross_margin,
          CASE WHEN revenue_ttm > 0 THEN operating_income_ttm / revenue_ttm END AS op_margin, CASE WHEN avg_assets_ttm > 0 THEN revenue_ttm / avg_assets_ttm END AS asset_turnover, filing_date AS as_of_date FROM ttm""",
    "scores": """
        SELECT event_id, n_name AS symbol, CAST(ts AS DATE) - 8766 AS trade_date, CASE WHEN event_type IN ('click', 'view') THEN 'news' WHEN event_type = 'error' THEN '8K' ELSE 'press' END AS kind,
          event_id // 2 AS accession, v % 601 AS pos, v * 7 % 400 AS neg, 1000 - v % 601 - v * 7 % 400 AS neu, v % 601 - v * 7 % 400 AS score
        FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM events) JOIN nation ON user_id % 25 = n_nationkey""",
    "news": """
        SELECT symbol, trade_date, """
    + ", ".join(f"CAST(round(CAST(sum({c}) AS DOUBLE) / count(*) / 1000.0::DOUBLE * 1e6) AS BIGINT) AS news_{c}" for c in ("pos", "neu", "neg", "score"))
    + """, CAST(round(sqrt(CAST(count(*) * sum(score * score) - sum(score) * sum(score) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE) * (count(*) - 1), 0)) / 1000.0::DOUBLE * 1e6) AS BIGINT) AS news_disp, count(*) AS n_news
        FROM scores WHERE kind = 'news' GROUP BY ALL""",
    "press": """
        SELECT symbol, trade_date, """
    + ", ".join(f"CAST(round(CAST(sum({c}) AS DOUBLE) / count(*) / 1000.0::DOUBLE * 1e6) AS BIGINT) AS press_{c}" for c in ("pos", "neu", "neg", "score"))
    + """, count(*) AS n_press FROM scores WHERE kind = 'press' GROUP BY ALL""",
    "filings": "SELECT symbol, trade_date, count(DISTINCT accession) AS n_8k FROM scores WHERE kind = '8K' GROUP BY ALL",
    "calendar": """
        SELECT md5(d::VARCHAR) AS date_key, d AS full_date, year(d) AS year, month(d) AS month, day(d) AS day, weekofyear(d) AS week, dayofweek(d) AS day_of_week, dayofweek(d) BETWEEN 1 AND 5 AS is_trading_day
        FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d)""",
    "companies": f"""
        SELECT {_KEY('n_name')} AS company_key, n_name AS symbol, {_KEY('r_name')} AS sector_key, r_name AS sector_name FROM nation JOIN region ON n_regionkey = r_regionkey
        WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))""",
    "grid": """
        SELECT date_key, company_key, full_date, coalesce(news_pos, 0) AS news_pos, coalesce(news_neg, 0) AS news_neg, coalesce(news_score, 0) AS news_score, coalesce(news_disp, 0) AS news_disp,
          coalesce(n_news, 0) AS n_news, coalesce(press_score, 0) AS press_score, coalesce(n_8k, 0) AS n_8k
        FROM calendar CROSS JOIN companies LEFT JOIN news ON news.symbol = companies.symbol AND news.trade_date = full_date LEFT JOIN press ON press.symbol = companies.symbol AND press.trade_date = full_date
          LEFT JOIN filings ON filings.symbol = companies.symbol AND filings.trade_date = full_date WHERE is_trading_day""",
    "senti": """
        SELECT CAST(row_number() OVER (ORDER BY full_date, company_key) + 1000 AS BIGINT) AS fact_sentiment_key, date_key, company_key, """
    + ", ".join(
        f"coalesce(CAST(sum(nullif({c}, 0)) OVER {w} AS DOUBLE) / nullif(count(nullif({c}, 0)) OVER {w}, 0) / 1e6, 0.0::DOUBLE) AS {n}"
        for c, w, n in (("news_score", "w3", "finbert_news_mean_3d"), ("news_score", "w30", "finbert_news_mean_30d"), ("press_score", "w30", "finbert_press_30d"), ("news_pos", "w3", "finbert_news_pos_3d"), ("news_neg", "w3", "finbert_news_neg_3d"), ("news_pos", "w30", "finbert_news_pos_30d"), ("news_neg", "w30", "finbert_news_neg_30d"), ("news_disp", "w3", "news_disp_3d"))
    )
    + """, CAST(sum(n_news) OVER w3 AS BIGINT) AS n_news_3d, CAST(sum(n_8k) OVER w30 AS BIGINT) AS n_8k_30d,
          coalesce(CAST(news_score - lag(news_score, 5) OVER (PARTITION BY company_key ORDER BY full_date) AS DOUBLE) / 1e6, 0.0::DOUBLE) AS news_mean_change_5d, full_date AS as_of_date
        FROM grid WINDOW w3 AS (PARTITION BY company_key ORDER BY full_date ROWS 2 PRECEDING), w30 AS (PARTITION BY company_key ORDER BY full_date ROWS 29 PRECEDING)""",
    "pooled": """
        SELECT n_name AS symbol, DATE '1995-01-01' + CAST(vec_id % 40 * 60 AS INTEGER) AS pc_date, """
    + ", ".join(f"CAST(sum(CAST(round(CAST(embedding[{i}] AS DOUBLE) * 1e6) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS v{i}" for i in range(1, 65))
    + """ FROM embeddings JOIN nation ON label = n_nationkey GROUP BY ALL""",
    "pcs": "SELECT symbol, pc_date, "
    + ", ".join("CAST(" + " + ".join(f"CAST(round(v{j} * 1e6) AS BIGINT)" for j in range(i, 65, 5)) + f" AS DOUBLE) / 1e6 AS filing_pc{i}" for i in range(1, 6))
    + " FROM pooled",
    "asof_funds": "SELECT p.*, f.* EXCLUDE (symbol, company_key, as_of_date) FROM prices p ASOF LEFT JOIN funds f ON p.symbol = f.symbol AND p.trade_date >= f.filing_date",
    "asof_all": f"""
        SELECT a.*, pc_date, {', '.join(PCS)}, lead(close_px, 5) OVER (PARTITION BY a.symbol ORDER BY trade_date) AS ahead
        FROM asof_funds a ASOF LEFT JOIN pcs ON a.symbol = pcs.symbol AND a.trade_date >= pcs.pc_date""",
    "panel": f"""
        SELECT CAST(row_number() OVER (ORDER BY trade_date, company_key) + 1000 AS BIGINT) AS fact_panel_key, * FROM (
        SELECT price_key, a.date_key, a.company_key, c.sector_key, a.symbol, trade_date, close_px, log_ret_1d, sma_5, sma_20, sma_50, ema_12, ema_26, rsi_14, macd_hist, bb_z, vol_20d, {', '.join(RATIOS)},
          CASE WHEN net_income_ttm > 0 AND close_px > 0 THEN close_px / net_income_ttm * 1e9 END AS pe_ttm_proxy, CASE WHEN total_equity > 0 AND close_px > 0 THEN close_px / (total_equity / 1e9) END AS pb_proxy,
          CASE WHEN ebitda_ttm > 0 AND total_assets > 0 THEN ebitda_ttm / nullif(total_assets - cash + total_debt, 0) END AS ebitda_to_ev_proxy, CASE WHEN total_assets > 0 THEN free_cash_flow_ttm / total_assets END AS fcf_to_assets,
          """
    + ", ".join(f"coalesce(s.{c}, {'0' if c.startswith('n_') else '0.0::DOUBLE'}) AS {c}" for c in ("finbert_news_mean_3d", "finbert_news_mean_30d", "finbert_press_30d", "n_news_3d", "n_8k_30d", "finbert_news_pos_3d", "finbert_news_neg_3d", "finbert_news_pos_30d", "finbert_news_neg_30d", "news_mean_change_5d", "news_disp_3d"))
    + ", "
    + ", ".join(f"CAST(c.sector_name = '{s}' AS BIGINT) AS is_{s.lower().replace(' ', '_')}" for s in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))
    + """, vol_20d * coalesce(s.finbert_news_mean_3d, 0.0::DOUBLE) AS senti_x_vol, abs(log_ret_1d) * coalesce(s.finbert_news_mean_3d, 0.0::DOUBLE) AS senti_x_absret, CAST(coalesce(s.n_news_3d, 0) AS DOUBLE) * vol_20d AS newsvol_x_vol, """
    + ", ".join(f"coalesce({c}, 0.0::DOUBLE) AS {c}" for c in PCS)
    + """, CAST(coalesce(ahead > close_px, false) AS BIGINT) AS y_5d_up, greatest(a.as_of_date, filing_date, s.as_of_date, pc_date) AS as_of_date
        FROM asof_all a JOIN companies c ON a.company_key = c.company_key LEFT JOIN senti s ON s.date_key = a.date_key AND s.company_key = a.company_key WHERE log_ret_1d IS NOT NULL)""",
    "both_daily": """
        SELECT coalesce(n.symbol, p.symbol) AS symbol, coalesce(n.trade_date, p.trade_date) AS trade_date, CAST(news_score AS DOUBLE) / 1e6 AS news_score, n_news, CAST(press_score AS DOUBLE) / 1e6 AS press_score, n_press
        FROM news n FULL JOIN press p ON n.symbol = p.symbol AND n.trade_date = p.trade_date""",
    "panel_b": f"""
        SELECT price_key, date_key, company_key, a.symbol, a.trade_date, log_ret_1d, sma_5, sma_20, sma_50, ema_12, ema_26, macd_hist, bb_z, vol_20d, {', '.join(RATIOS)},
          round(CASE WHEN ahead IS NOT NULL AND close_px > 0 THEN ln(ahead / close_px) END, 6) AS y_5d_logret, CASE WHEN ahead IS NOT NULL AND close_px > 0 THEN CAST(ahead > close_px AS BIGINT) END AS y_5d_up,
          news_score, n_news, press_score, n_press, {', '.join(PCS)}
        FROM asof_all a LEFT JOIN both_daily b ON a.symbol = b.symbol AND a.trade_date = b.trade_date WHERE company_key IN (SELECT company_key FROM companies)""",
    "preds": """
        SELECT date_key, company_key, symbol, trade_date, model_rung, prob_up, CAST(prob_up > 0.5 AS BIGINT) AS predicted_class, y_5d_up FROM (
          SELECT *, round(1 / (1 + exp(-z)), 5) AS prob_up FROM (
            SELECT *, 0::BIGINT AS model_rung, log_ret_1d * 0.5::DOUBLE AS z FROM panel UNION ALL SELECT *, 1, bb_z * -0.3::DOUBLE + log_ret_1d * 0.2::DOUBLE FROM panel
            UNION ALL SELECT *, 2, bb_z * -0.3::DOUBLE + finbert_news_mean_3d * 2.0::DOUBLE + vol_20d * 0.01::DOUBLE FROM panel))""",
    "attributed": """
        SELECT symbol, trade_date, model_rung, string_agg('  - ' || f || ': ' || CASE WHEN v >= 0 THEN '+' ELSE '-' END || format('{:.4f}', abs(v)), chr(10) ORDER BY abs(v) DESC, f) AS block FROM (
          SELECT symbol, trade_date, 0::BIGINT AS model_rung, 'log_ret_1d' AS f, log_ret_1d * 0.5::DOUBLE AS v FROM panel
          UNION ALL SELECT symbol, trade_date, 1, unnest(['bb_z', 'log_ret_1d']), unnest([bb_z * -0.3::DOUBLE, log_ret_1d * 0.2::DOUBLE]) FROM panel
          UNION ALL SELECT symbol, trade_date, 2, unnest(['bb_z', 'finbert_news_mean_3d', 'vol_20d']), unnest([bb_z * -0.3::DOUBLE, finbert_news_mean_3d * 2.0::DOUBLE, vol_20d * 0.01::DOUBLE]) FROM panel)
        WHERE v IS NOT NULL GROUP BY ALL""",
    "fold_rows": """
        SELECT CAST(first AS VARCHAR) || CASE WHEN first + 63 > DATE '2001-08-01' THEN '_partial' ELSE '' END AS fold_id, first - 10 - 1095 AS train_start, first - 10 AS train_end, first AS test_start, least(first + 63, DATE '2001-08-01') AS test_end
        FROM (SELECT CAST(DATE '1995-01-01' + 1095 + CAST(63 * i AS INTEGER) AS DATE) AS first FROM range(100) t(i)) WHERE first + 14 <= DATE '2001-08-01'""",
    "assigned": """
        SELECT p.*, f.fold_id FROM preds p JOIN fold_rows f ON trade_date BETWEEN test_start AND test_end QUALIFY row_number() OVER (PARTITION BY model_rung, company_key, trade_date ORDER BY test_start DESC) = 1""",
    "aucs": """
        SELECT model_rung, fold_id, count(*) AS n, CAST(sum(y_5d_up) AS BIGINT) AS n_pos, CAST(2 * sum(rk) FILTER (y_5d_up = 1) - sum(y_5d_up) * (sum(y_5d_up) + 1) AS DOUBLE) / CAST(2 * sum(y_5d_up) * (count(*) - sum(y_5d_up)) AS DOUBLE) AS auc
        FROM (SELECT *, rank() OVER (PARTITION BY model_rung, fold_id ORDER BY prob_up) + (count(*) OVER (PARTITION BY model_rung, fold_id, prob_up) - 1) / 2.0 AS rk FROM assigned)
        GROUP BY ALL HAVING sum(y_5d_up) > 0 AND sum(y_5d_up) < count(*)""",
    "traded": "SELECT * REPLACE (sma_50 AS close_px) FROM prices",
    "fwd": """
        SELECT company_key, trade_date, CASE WHEN close_px > 0 THEN (lead(close_px, 5) OVER (PARTITION BY company_key ORDER BY trade_date) - close_px) / close_px END AS fwd_ret FROM traded""",
    "picks": """
        SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY model_rung ORDER BY trade_date) - 1 AS day_no FROM assigned) WHERE day_no % 5 = 0
        QUALIFY row_number() OVER (PARTITION BY model_rung, trade_date ORDER BY prob_up DESC, company_key) <= 5""",
    "baskets": """
        SELECT model_rung, trade_date, count(r) AS n_long, CAST(sum(r) AS DOUBLE) / count(r) / 1e9 AS gross, list(company_key) AS basket
        FROM (SELECT p.*, CAST(round(fwd_ret * 1e9) AS BIGINT) AS r FROM picks p LEFT JOIN fwd USING (company_key, trade_date)) GROUP BY ALL HAVING count(r) > 0""",
    "nets": """
        SELECT *, gross - tx_cost AS net FROM (SELECT *, CAST(len(list_filter(basket, lambda x: NOT list_contains(old, x))) + len(list_filter(old, lambda x: NOT list_contains(basket, x))) AS DOUBLE) / 10.0::DOUBLE * 0.0005::DOUBLE AS tx_cost
        FROM (SELECT *, coalesce(lag(basket) OVER (PARTITION BY model_rung ORDER BY trade_date), []) AS old FROM baskets))""",
    "pnl": """
        SELECT model_rung, trade_date, n_long, round(gross, 6) AS gross_ret, round(tx_cost, 6) AS tx_cost, round(net, 6) AS net_ret, round(product(1 + net) OVER (PARTITION BY model_rung ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1, 6) AS cum_net_ret FROM nets""",
    "bench": """
        SELECT trade_date, round(product(1 + day) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1, 6) AS benchmark_cum FROM (
          SELECT trade_date, CAST(sum(r) AS DOUBLE) / count(r) / 1e9 AS day FROM (
            SELECT trade_date, CASE WHEN before > 0 THEN CAST(round((close_px - before) / before * 1e9) AS BIGINT) END AS r FROM (SELECT *, lag(close_px) OVER (PARTITION BY symbol ORDER BY trade_date) AS before FROM traded)) WHERE r IS NOT NULL GROUP BY ALL)
        WHERE trade_date BETWEEN (SELECT min(trade_date) FROM baskets) AND (SELECT max(trade_date) FROM baskets)""",
    "pnl_bench": "SELECT md5(trade_date::VARCHAR) AS date_key, pnl.*, benchmark_cum FROM pnl LEFT JOIN bench USING (trade_date)",
    "types": "SELECT md5(lower(trim(code))) AS filing_type_key, code, label FROM (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in FILING_TYPES) + ") AS t(code, label)",
    "words_docs": r"""
        SELECT doc_id, lang, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda w: w <> '') AS w FROM documents""",
    "chunk_rows": """
        SELECT '10K-' || lang || '-' || d::VARCHAR || '-' || right(doc_id::VARCHAR, 6) || '-c' || format('{:02d}', i) AS chunk_key, doc_id::VARCHAR AS accession, lang AS symbol, i AS chunk_index, CAST(len(w[i * 450 + 1 : i * 450 + 500]) AS BIGINT) AS n_tokens,
          array_to_string(w[i * 450 + 1 : i * 450 + 500], ' ') AS body_chunk, d AS as_of_date
        FROM (SELECT *, DATE '1995-01-01' + CAST(doc_id % 2000 AS INTEGER) AS d, unnest(range(0, CASE WHEN len(w) >= 50 THEN (len(w) - 50) // 450 + 1 ELSE 0 END)) AS i FROM words_docs)""",
    "all_chunks": """
        SELECT replace(chunk_key, '10K-', t || '-') AS chunk_key, symbol, as_of_date, t AS source_type, body_chunk FROM (SELECT *, CASE WHEN CAST(accession AS BIGINT) % 4 = 0 THEN '8K' ELSE '10K' END AS t FROM chunk_rows)""",
    "chunk_words": """
        SELECT chunk_key, symbol, as_of_date, source_type, body_chunk, ('0x' || substr(m, 1, 8))::BIGINT % 384 AS dim, sum(CASE WHEN substr(m, 9, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN 1 ELSE -1 END) AS w FROM (
          SELECT *, md5(unnest(string_split(lower(body_chunk), ' '))) AS m FROM all_chunks) GROUP BY ALL""",
    "questions": """
        SELECT item_id AS query_id, text AS question, CASE WHEN item_id % 4 = 0 THEN NULL ELSE ['de', 'en', 'es', 'fr'][item_id % 4 + 1] END AS symbol,
          CASE WHEN item_id % 5 = 0 THEN NULL ELSE DATE '1996-01-01' + CAST(item_id % 40 * 50 AS INTEGER) END AS as_of_date, CASE WHEN item_id % 3 = 0 THEN ['8K'] END AS source_types, CAST(item_id % 3 AS BIGINT) AS rung FROM benchmark""",
    "question_words": r"""
        SELECT query_id, ('0x' || substr(m, 1, 8))::BIGINT % 384 AS dim, sum(CASE WHEN substr(m, 9, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN 1 ELSE -1 END) AS w FROM (
          SELECT query_id, md5(unnest(list_filter(regexp_split_to_array(lower(question), '[ \t\n\r]+'), lambda x: x <> ''))) AS m FROM questions) GROUP BY ALL""",
    "retrieved": """
        SELECT query_id, chunk_key AS item_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_key) AS BIGINT) AS rank FROM (
          SELECT q.query_id, c.chunk_key, round(coalesce(dot, 0) / CASE WHEN q.len * c.len > 0 THEN sqrt(CAST(q.len AS DOUBLE)) * sqrt(CAST(c.len AS DOUBLE)) ELSE 1 END, 9) AS similarity
          FROM (SELECT questions.*, coalesce(len, 0) AS len FROM questions LEFT JOIN (SELECT query_id, sum(w * w) AS len FROM question_words GROUP BY ALL) USING (query_id)) q
          JOIN (SELECT chunk_key, symbol, as_of_date, source_type, sum(w * w) AS len FROM chunk_words GROUP BY ALL) c
            ON (q.symbol IS NULL OR q.symbol = c.symbol) AND (q.as_of_date IS NULL OR c.as_of_date <= q.as_of_date) AND (q.source_types IS NULL OR list_contains(q.source_types, c.source_type))
          LEFT JOIN (SELECT query_id, chunk_key, sum(a.w * b.w) AS dot FROM question_words a JOIN chunk_words b USING (dim) GROUP BY ALL) d ON d.query_id = q.query_id AND d.chunk_key = c.chunk_key)
        QUALIFY rank <= 5""",
    "asked": "SELECT vec_id AS query_id, embedding AS q, label AS q_label FROM embeddings WHERE vec_id % 50 = 0",
    "nearest": """
        SELECT query_id, item_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS BIGINT) AS rank FROM (
          SELECT query_id, vec_id AS item_id, round(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS similarity FROM asked CROSS JOIN embeddings)
        QUALIFY rank <= 8""",
}


def sql(body: str) -> str:
    """``body`` with the relations that it needs."""
    needed: set[str] = set()

    def visit(text: str, before: list[str]) -> None:
        for i, name in enumerate(before):
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(RELATIONS[name], before[:i])

    visit(body, list(RELATIONS))
    order = [n for n in RELATIONS if n in needed]
    return ("WITH " + ",\n".join(f"{n} AS ({RELATIONS[n]})" for n in order) + "\n" if order else "") + body


def mask(column: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({column}, ''), '{EMAIL}', '[EMAIL]', 'g'), '{PHONE}', '[PHONE]', 'g')"


def lexicon(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


__all__ = ["NEGATIVE", "POSITIVE", "RELATIONS", "lexicon", "mask", "sql"]
