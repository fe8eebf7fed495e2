"""Scalar column expressions: status classes, URIs, units, weights, maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's rules) ---------------------
# engagement weight per event type; unknown types weigh 1.0
EVENT_WEIGHTS = {"view_complete": 4.0, "rating": 3.0, "view_start": 1.0, "search": 0.5}
ALLOWED_ENGAGEMENT = ["view_start", "view_complete", "rating", "search"]
# classifier category -> sentiment; unknown -> neutral
SENTIMENT = {"greeting": "positive", "farewell": "neutral", "question": "neutral",
             "exclamation": "positive", "neutral": "neutral"}
# --------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def status_class(code) -> Column:
    """1xx..5xx, else unknown."""
    s = _c(code)
    out = F.lit("unknown")
    for lo in (500, 400, 300, 200, 100):
        out = F.when(s.between(lo, lo + 99), F.lit(f"{lo // 100}xx")).otherwise(out)
    return out


def normalize_uri(uri) -> Column:
    """E5: path variables replaced in the reference's order."""
    u = F.regexp_replace(_c(uri), r"/hello/[^/]+", "/hello/{name}")
    u = F.regexp_replace(u, r"/users/[^/]+", "/users/{id}")
    return F.regexp_replace(u, r"/\d+", "/{id}")


_NUM_PREFIX = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"


def leading_number(s) -> Column:
    """parseFloat: the longest numeric prefix, null when there is none."""
    return F.regexp_extract(_c(s), _NUM_PREFIX, 1).try_cast("double")


def size_to_bytes(s) -> Column:
    """E6: '1.5GiB' -> bytes with 1024 multipliers (GiB=GB, MiB=MB, KiB=KB, B);
    unparsable -> 0."""
    v = F.upper(_c(s))
    num = leading_number(s)
    mult = (F.when(v.contains("GIB") | v.contains("GB"), F.lit(1024.0 ** 3))
            .when(v.contains("MIB") | v.contains("MB"), F.lit(1024.0 ** 2))
            .when(v.contains("KIB") | v.contains("KB"), F.lit(1024.0))
            .otherwise(F.lit(1.0)))
    return F.coalesce(num * mult, F.lit(0.0))


def percent_to_double(s) -> Column:
    """E6: '12.5%' -> 12.5; missing -> 0."""
    return F.coalesce(leading_number(F.regexp_replace(_c(s), "%", "")), F.lit(0.0))


def duration_to_ms(s) -> Column:
    """E6: 'Ns' / 'Nm' / 'Nh' -> milliseconds, anything else 30000."""
    m = F.regexp_extract(_c(s), r"^(\d+)(s|m|h)$", 1)
    u = F.regexp_extract(_c(s), r"^(\d+)(s|m|h)$", 2)
    n = m.try_cast("long")
    return (F.when(u == "s", n * 1000).when(u == "m", n * 60000)
            .when(u == "h", n * 3600000).otherwise(F.lit(30000)).cast("long"))


def event_weight(event_type, value=None) -> Column:
    """Weight by type (unknown 1.0) times value."""
    m = F.create_map(*[x for k, w in EVENT_WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    w = F.coalesce(m[_c(event_type)], F.lit(1.0))
    return w if value is None else w * _c(value)


def sentiment_of(category) -> Column:
    """E10."""
    m = F.create_map(*[x for k, v in SENTIMENT.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[_c(category)], F.lit("neutral"))


def rating_from_score(score) -> Column:
    """round(clamp(log10(score+1)/log10(1001)*9+1, 1, 10), 1)."""
    r = F.log10(_c(score).cast("double") + 1) / F.log10(F.lit(1001.0)) * 9 + 1
    return F.round(F.least(F.greatest(r, F.lit(1.0)), F.lit(10.0)), 1)


def genres_join(arr) -> Column:
    """E14."""
    return F.concat_ws(",", _c(arr))


def genres_split(s) -> Column:
    """Empty string -> empty array."""
    return F.when(F.coalesce(_c(s), F.lit("")) == "", F.array().cast("array<string>")) \
        .otherwise(F.split(_c(s), ","))


def threshold_op(op, value, limit) -> Column:
    """E15: '>', '<', '>=', '<=' ; unknown operator -> false."""
    o, v, lim = _c(op), _c(value), _c(limit)
    return (F.when(o == ">", v > lim).when(o == "<", v < lim)
            .when(o == ">=", v >= lim).when(o == "<=", v <= lim).otherwise(F.lit(False)))


def format_pct_change(pct) -> Column:
    """E16: '+x.x%' (sign only when positive)."""
    p = _c(pct)
    return F.concat(F.when(p > 0, F.lit("+")).otherwise(F.lit("")),
                    F.format_string("%.1f", p), F.lit("%"))


def fix_priority(conf) -> Column:
    """E17."""
    c = _c(conf)
    return F.when(c >= 70, "HIGH").when(c >= 40, "MEDIUM").otherwise("LOW")


def health_rollup(checks) -> Column:
    """Every check 'UP' -> healthy, else unhealthy."""
    return F.when(F.forall(F.map_values(_c(checks)), lambda v: v == "UP"), "healthy") \
        .otherwise("unhealthy")


def scale_ratio(num, den, factor: float = 100.0) -> Column:
    """Num / den * factor, null on zero denominator."""
    return F.try_divide(_c(num), _c(den)) * F.lit(factor)


def severity_rank(sev) -> Column:
    """T-K3: critical < high < medium < low (critical first, see Q1)."""
    s = _c(sev)
    return (F.when(s == "critical", 0).when(s == "high", 1)
            .when(s == "medium", 2).otherwise(3))
