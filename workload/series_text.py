"""Time-series and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsonde.functions.text import KEPT, NEGATIVE, POSITIVE, STOP_WORDS
from tabsonde.operators import text as X
from tabsonde.operators import timeseries as S
from workload.common import NUDGE, query, rnd, rounded

DAILY = "s AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, avg(o_totalprice) AS value FROM orders GROUP BY ALL), " \
        "p AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM s)"
DAILY_KEYED = "s AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS value FROM events GROUP BY ALL), " \
              "p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS pos FROM s)"


def daily(t):
    return S.aggregate(t.orders, "o_orderdate", "o_totalprice")


def hourly(t):
    return S.aggregate(t.events, "ts", "value", ["event_type"], "hour")


@query("ts_aggregate", f"WITH {DAILY} SELECT ts, {rnd('value', 6, NUDGE)} AS value FROM s")
def ts_aggregate(t):
    return rounded(daily(t), 6, NUDGE)


@query("ts_line", f"WITH {DAILY_KEYED} SELECT event_type, ts, {rnd('value')} AS value FROM s")
def ts_line(t):
    return rounded(S.line(t.events, "ts", "value", ["event_type"], "hour"))


@query("pct_change", f"WITH {DAILY} SELECT ts, {rnd('value', 6, NUDGE)} AS value, {rnd('(value - lag(value) OVER (ORDER BY ts)) / lag(value) OVER (ORDER BY ts)', 4, NUDGE)} AS change FROM s")
def pct_change(t):
    return rounded(S.percent_change(daily(t)), 4, NUDGE, value=6)


@query("volatility", f"""WITH {DAILY_KEYED}, c AS (SELECT event_type, (value - lag(value) OVER w) / lag(value) OVER w AS change FROM s WINDOW w AS (PARTITION BY event_type ORDER BY ts))
 SELECT event_type, {rnd('stddev_samp(change)')} AS volatility FROM c GROUP BY event_type""")
def volatility(t):
    return rounded(S.volatility(hourly(t), ["event_type"]))


@query("period_join", f"""WITH {DAILY} SELECT ts, pos, pos % 12 AS phase, {rnd('value', 6, NUDGE)} AS value, {rnd('avg(value) OVER (PARTITION BY pos % 12)', 4, NUDGE)} AS phase_mean FROM p""")
def period_join(t):
    return rounded(S.seasonal_means(daily(t), 12), 4, NUDGE, value=6)


def decomposition(period: int, additive: bool, source: str = DAILY, by: str = "") -> str:
    k = period // 2
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    total = f"sum(value) OVER ({part}ORDER BY ts ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    if period % 2 == 0:
        total = f"({total} - (lag(value, {k}) OVER ({part}ORDER BY ts) + lead(value, {k}) OVER ({part}ORDER BY ts)) / 2)"
    op, inv = ("-", "-") if additive else ("/", "/")
    return f"""{source}, tr AS (SELECT {keys}ts, pos, value, CASE WHEN count(*) OVER ({part}ORDER BY ts ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) = {2 * k + 1}
   THEN {total} / {period} END AS trend FROM p),
 ph AS (SELECT {keys}pos % {period} AS phase, avg(value {op} trend) AS m FROM tr GROUP BY ALL),
 pc AS (SELECT {keys}phase, m {inv} avg(m) OVER ({part}) AS seasonal FROM ph),
 dc AS (SELECT {', '.join(f'tr.{c}' for c in [*([by] if by else []), 'ts', 'pos', 'value', 'trend'])}, seasonal,
   {'value - trend - seasonal' if additive else 'value / (trend * seasonal)'} AS residual
   FROM tr JOIN pc ON pos % {period} = phase{f' AND tr.{by} = pc.{by}' if by else ''})"""


PARTS = ", ".join(f"{rnd(c, 6, NUDGE)} AS {c}" for c in ["value", "trend", "seasonal", "residual"])


@query("ts_decompose", f"WITH {decomposition(12, True)} SELECT ts, pos, {PARTS} FROM dc")
def ts_decompose(t):
    return rounded(S.decompose(daily(t), 12), 6, NUDGE)


@query("ts_decompose_multiplicative", f"WITH {decomposition(7, False, DAILY_KEYED, 'event_type')} SELECT event_type, ts, pos, {PARTS} FROM dc")
def ts_decompose_multiplicative(t):
    return rounded(S.decompose(hourly(t), 7, "multiplicative", ["event_type"]), 6, NUDGE)


@query("ts_seasonality_strength", f"WITH {decomposition(4, True)} SELECT {rnd('var_samp(seasonal) / var_samp(value)', 6)} AS strength FROM dc")
def ts_seasonality_strength(t):
    return rounded(S.seasonality_strength(daily(t)), 6)


@query("ts_periodogram", f"""WITH {DAILY}, c AS (SELECT pos, n, value - avg(value) OVER () AS v FROM p), f AS (SELECT unnest(range(1, CAST(max(n) / 2 AS BIGINT) + 1)) AS k FROM p),
 w AS (SELECT k, n, power(sum(v * cos(2 * pi() * k * pos / n)), 2) + power(sum(v * sin(2 * pi() * k * pos / n)), 2) AS power FROM c, f WHERE k <= n // 2 GROUP BY k, n),
 r AS (SELECT *, row_number() OVER (ORDER BY power DESC) AS rank FROM w)
 SELECT rank, k AS frequency, {rnd('n / k')} AS period, {rnd('power / 1e6', 3)} AS power FROM r WHERE rank <= 10""")
def ts_periodogram(t):
    out = S.periodogram(daily(t))
    return rounded(out.withColumn("power", out.power / 1e6), 4, power=3)


@query("ts_adf", f"""WITH {DAILY_KEYED}, d AS (SELECT event_type, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS x, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS y FROM p),
 r AS (SELECT event_type, regr_count(y, x) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM d GROUP BY event_type)
 SELECT event_type, n, {rnd('b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)')} AS statistic, CAST(0 AS BIGINT) AS lags FROM r""")
def ts_adf(t):
    return rounded(S.unit_root_test(hourly(t), ["event_type"], 0, False).drop("p_value", "is_stationary"))


@query("ts_adf_auto_lag")
def ts_adf_auto_lag(t):
    return S.unit_root_test(hourly(t), ["event_type"])


@query("ts_kpss", f"""WITH {DAILY}, e AS (SELECT pos, n, value - avg(value) OVER () AS e FROM p),
 lim AS (SELECT CAST(floor(power(max(n), 2.0 / 9)) AS BIGINT) AS l, max(n) AS n FROM e),
 ac AS (SELECT CAST(b.pos - a.pos AS BIGINT) AS k, sum(a.e * b.e) / max(a.n) AS c FROM e a JOIN e b ON b.pos - a.pos BETWEEN 0 AND 100 GROUP BY ALL),
 sg AS (SELECT sum(CASE WHEN k = 0 THEN c WHEN k <= l THEN 2 * c ELSE 0 END) AS s0, sum(CASE WHEN k <= l THEN 2 * k * c ELSE 0 END) AS s1, max(n) AS n FROM ac, lim),
 q AS (SELECT CAST(floor(1.1447 * power(power(s1 / s0, 2), 1.0 / 3) * power(n, 1.0 / 3)) AS BIGINT) AS lags, n FROM sg),
 v AS (SELECT sum(CASE WHEN k = 0 THEN c WHEN k <= lags THEN 2 * (1 - k / (lags + 1.0)) * c ELSE 0 END) AS v, max(lags) AS lags, max(n) AS n FROM ac, q),
 cs AS (SELECT sum(power(cum, 2)) AS ss FROM (SELECT sum(e) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM e))
 SELECT n, {rnd('ss / (CAST(n AS DOUBLE) * n * v)', 6)} AS statistic, lags FROM v, cs""")
def ts_kpss(t):
    return rounded(S.stationarity_test(daily(t)).drop("p_value", "is_stationary"), 6)


@query("ts_trend", f"""WITH {decomposition(12, True, DAILY_KEYED, 'event_type')},
 r AS (SELECT event_type, regr_count(value, pos) AS n, regr_slope(value, pos) AS slope, regr_r2(value, pos) AS r2 FROM p GROUP BY event_type),
 st AS (SELECT event_type, stddev_samp(seasonal) / stddev_samp(value) AS ss FROM dc GROUP BY event_type),
 vo AS (SELECT event_type, stddev_samp(change) AS v FROM (SELECT event_type, (value - lag(value) OVER w) / lag(value) OVER w AS change FROM s WINDOW w AS (PARTITION BY event_type ORDER BY ts)) GROUP BY event_type),
 -- 1.9599 is the 5 % point of t for large samples
 g AS (SELECT *, sqrt(r2 * (n - 2) / (1 - r2)) > 1.963 AS real FROM r JOIN st USING (event_type) JOIN vo USING (event_type) WHERE n >= 10)
 SELECT event_type, n, {rnd('slope', 6)} AS slope, {rnd('r2', 6)} AS r_squared, CASE WHEN real AND slope > 0 THEN 'upward' WHEN real THEN 'downward' ELSE 'none' END AS direction,
 CASE WHEN NOT real THEN 'weak' WHEN sqrt(r2) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength, {rnd('v')} AS volatility, {rnd('ss')} AS seasonal_strength, ss > 0.1 AS has_seasonality FROM g""")
def ts_trend(t):
    return rounded(S.trend(hourly(t), ["event_type"]).drop("p_value", "is_stationary"), 4, slope=6, r_squared=6)


@query("ts_forecast")
def ts_forecast(t):
    return rounded(S.forecast(hourly(t), (1, 1, 1), 24, ["event_type"], "1 hour"))


RAW = "s AS (SELECT event_type, ts::TIMESTAMP AS ts, avg(value) AS value FROM events GROUP BY ALL), " \
      "p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS pos FROM s)"


def raw(t):
    return S.aggregate(t.events, "ts", "value", ["event_type"], None)


@query("pct_change_raw", f"""WITH {RAW} SELECT event_type, ts, {rnd('value', 6)} AS value,
 {rnd('(value - lag(value) OVER w) / lag(value) OVER w', 4, NUDGE)} AS change FROM s WINDOW w AS (PARTITION BY event_type ORDER BY ts)""")
def pct_change_raw(t):
    return rounded(S.percent_change(raw(t), ["event_type"]), 4, NUDGE).withColumn("value", F.round("value", 6) + 0.0)


@query("ts_decompose_raw", f"WITH {decomposition(5, True, RAW, 'event_type')} SELECT event_type, ts, pos, {PARTS} FROM dc")
def ts_decompose_raw(t):
    return rounded(S.decompose(raw(t), 5, by=["event_type"]), 6, NUDGE)


@query("ts_likelihood", f"""WITH {DAILY}, c AS (SELECT pos, n, value - avg(value) OVER () AS v FROM p), f AS (SELECT unnest(range(1, CAST((max(n) - 1) // 2 AS BIGINT) + 1)) AS k FROM p),
 w AS (SELECT k, n, (power(sum(v * cos(2 * pi() * k * pos / n)), 2) + power(sum(v * sin(2 * pi() * k * pos / n)), 2)) / n AS i FROM c, f GROUP BY k, n),
 g AS (SELECT *, (power(1 + 0.2 * cos(2 * pi() * k / n), 2) + power(0.2 * sin(2 * pi() * k / n), 2))
  / (power(1 - 0.4 * cos(2 * pi() * k / n) + 0.1 * cos(4 * pi() * k / n), 2) + power(0.4 * sin(2 * pi() * k / n) - 0.1 * sin(4 * pi() * k / n), 2)) AS g FROM w),
 l AS (SELECT max(n) AS n, avg(i / g) AS variance, sum(ln(g)) AS lg FROM g)
 SELECT n, {rnd('variance / 1e6', 3)} AS variance, {rnd('-0.5 * n * (ln(2 * pi() * variance) + 1) - lg', 3)} AS loglik FROM l""")
def ts_likelihood(t):
    out = S.likelihood(daily(t), [0.4, -0.1], [0.2])
    return rounded(out.withColumn("variance", out.variance / 1e6), 3)


CLEAN = (f"trim(regexp_replace(regexp_replace(lower(text), '[^{KEPT}\\t\\n\\x0B\\f\\r \\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', '', 'g'), "
         f"'[\\t\\n\\x0B\\f\\r \\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))")
# As they read once a text has been cleaned.
STOPS = ", ".join("'" + w.replace("'", "") + "'" for w in STOP_WORDS)
TERMS = f"""c AS (SELECT doc_id, {CLEAN} AS text FROM documents), w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS term FROM c),
 k AS (SELECT * FROM w WHERE length(term) >= 2 AND term NOT IN ({STOPS})), f AS (SELECT term, count(*) AS n FROM k GROUP BY term),
 top AS (SELECT * FROM f ORDER BY n DESC, term LIMIT 10)"""


@query("text_clean", f"SELECT doc_id, {CLEAN} AS text FROM documents")
def text_clean(t):
    return X.clean_text(t.documents.select("doc_id", "text"), "text")


@query("keywords_frequency", f"WITH {TERMS} SELECT * FROM top")
def keywords_frequency(t):
    return X.keywords_by_frequency(t.documents, "text")


@query("keywords_tfidf", f"""WITH {TERMS}, tf AS (SELECT doc_id, term, count(*) AS c FROM k SEMI JOIN top USING (term) GROUP BY ALL),
 idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
 wt AS (SELECT doc_id, term, c * idf AS w FROM tf JOIN idf USING (term)), nm AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS s FROM wt)
 SELECT term, {rnd('sum(s) / (SELECT count(*) FROM documents)', 6)} AS score FROM nm GROUP BY term""")
def keywords_tfidf(t):
    return rounded(X.keywords_by_tfidf(t.documents, "text"), 6)


@query("word_weights", f"""WITH {TERMS}, many AS (SELECT * FROM f ORDER BY n DESC, term LIMIT 200)
 SELECT term, n, {rnd('n / max(n) OVER ()', 6)} AS weight FROM many""")
def word_weights(t):
    return rounded(X.word_weights(t.documents, "text"), 6)


def listed(ws) -> str:
    return "(" + ", ".join(f"'{w}'" for w in ws) + ")"


# The documents are invented prose, so frequent words of theirs join the lexicon.
MORE_POSITIVE, MORE_NEGATIVE = [*POSITIVE, "the", "en"], [*NEGATIVE, "and", "der"]
SENTIMENT = f"""c AS (SELECT doc_id, string_split({CLEAN}, ' ') AS ws FROM documents),
 m AS (SELECT doc_id, len(list_filter(ws, lambda x: x IN {listed(MORE_POSITIVE)})) AS p, len(list_filter(ws, lambda x: x IN {listed(MORE_NEGATIVE)})) AS n FROM c),
 g AS (SELECT doc_id, p AS positive_words, n AS negative_words, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment,
   CASE WHEN p > n THEN p / (p + n) WHEN n > p THEN -n / (p + n) ELSE 0.0 END AS score FROM m)"""


@query("sentiment", f"WITH {SENTIMENT} SELECT doc_id, positive_words, negative_words, sentiment, {rnd('score', 6)} AS score FROM g")
def sentiment(t):
    return rounded(X.sentiment(t.documents.select("doc_id", "text"), "text", MORE_POSITIVE, MORE_NEGATIVE).drop("text"), 6)


@query("sentiment_summary", f"""WITH {SENTIMENT} SELECT sentiment, count(*) AS n, {rnd('avg(score)', 6)} AS mean_score,
 {rnd('(SELECT avg(score) FROM g)', 6)} AS average_score FROM g GROUP BY sentiment""")
def sentiment_summary(t):
    return rounded(X.sentiment_summary(t.documents, "text", positive=MORE_POSITIVE, negative=MORE_NEGATIVE), 6)


@query("topic_model")
def topic_model(t):
    return rounded(X.topics(t.documents, "text", 5, 10, iterations=10))


def topic_steps(k: int, steps: int) -> str:
    """The same steps in SQL, from the same fractions of digests."""
    each = lambda form: ", ".join(form.format(i=i) for i in range(k))
    plus = lambda form: " + ".join(form.format(i=i) for i in range(k))
    size = "(SELECT count(*) FROM w0)"
    out = f"""po AS MATERIALIZED (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS n FROM k GROUP BY ALL),
 w0 AS MATERIALIZED (SELECT term, {each("sum(n) * (CAST('0x' || substr(md5(term || ':{i}'), 1, 8) AS BIGINT) / 4294967296.0) AS w{i}")} FROM po GROUP BY term),
 t0 AS MATERIALIZED (SELECT doc_id, {each(f"sum(n) / {k} AS t{{i}}")} FROM po GROUP BY doc_id)"""
    for s in range(steps):
        out += f""", s{s} AS (SELECT {each(f"sum(w{{i}}) + {X.ETA} * {size} AS s{{i}}")} FROM w{s}),
 p{s} AS (SELECT po.doc_id, po.term, n, {each(f"(w{{i}} + {X.ETA}) / s{{i}} * (t{{i}} + {X.ALPHA}) AS p{{i}}")} FROM po JOIN w{s} USING (term) JOIN t{s} USING (doc_id), s{s}),
 r{s} AS MATERIALIZED (SELECT doc_id, term, {each("n * p{i} / (" + plus("p{i}") + ") AS r{i}")} FROM p{s}),
 w{s + 1} AS MATERIALIZED (SELECT term, {each("sum(r{i}) AS w{i}")} FROM r{s} GROUP BY term), t{s + 1} AS MATERIALIZED (SELECT doc_id, {each("sum(r{i}) AS t{i}")} FROM r{s} GROUP BY doc_id)"""
    return out


@query("topic_model_steps", f"WITH {TERMS.rsplit(', f AS', 1)[0]}, {topic_steps(3, 2)} SELECT term, {', '.join(rnd(f'w{i}', 5) + f' AS w{i}' for i in range(3))} FROM w2")
def topic_model_steps(t):
    return rounded(X.fit_topics(t.documents, "text", 3, 2).words.select("term", "w0", "w1", "w2"), 5)


@query("topic_mixture")
def topic_mixture(t):
    return rounded(X.topic_mixture(t.documents, "text", ["doc_id"], 5, iterations=5))
