"""Scores, classifications and validation rules.

All rules are Catalyst ``when`` chains over columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions import urls

# ---------------------------------------------------------------------------
# Fixed values the results depend on.
# ---------------------------------------------------------------------------
# Health score (0–100) of one site check.
HEALTH_START = 100
HEALTH_NOT_200 = 50
HEALTH_SLOW = [(3.0, 30), (1.0, 15), (0.5, 5)]
HEALTHY_ABOVE = 80
ISSUE_VERY_SLOW = "Very slow response time"
ISSUE_SLOW = "Slow response time"
REC_SERVER = "Check server configuration and error logs"
REC_SLOW = ["Optimize server performance", "Consider CDN implementation", "Review database query performance"]
# Engagement weights: likes, shares, comments.
ENGAGEMENT_WEIGHTS = (1, 3, 2)
# Quality score fields and bonus rules.
QUALITY_FIELDS = ["title", "price", "description", "images", "availability"]
# Category keywords, checked in this order; first hit wins.
CATEGORY_KEYWORDS = [
    ("electronics", ["phone", "laptop", "computer", "tablet", "camera"]),
    ("clothing", ["shirt", "pants", "dress", "shoes", "jacket"]),
    ("books", ["book", "novel", "guide", "manual"]),
    ("home", ["furniture", "decor", "kitchen", "bathroom"]),
    ("toys", ["toy", "game", "puzzle", "doll"]),
]
# Currency rates against USD.
CURRENCY_RATES = [("USD", 1.0), ("EUR", 0.85), ("GBP", 0.73), ("JPY", 110.0)]
# Proxy status thresholds on health: per result, and in the periodic sweep.
PROXY_STATUS_PER_RESULT = [(0.3, "blocked"), (0.5, "rate_limited")]
PROXY_STATUS_SWEEP = [(0.2, "blocked"), (0.4, "rate_limited")]
# Retryable HTTP codes.
RETRY_CODES = [500, 502, 503, 504, 408, 429]
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def status_class(code) -> Column:
    """success for 2xx, failure for >= 400, else other."""
    c = _col(code)
    return F.when((c >= 200) & (c < 300), "success").when(c >= 400, "failure").otherwise("other")


def error_status(error_type, status_code, message) -> Column:
    """Attempt status from the error class, code and message text."""
    et, sc, msg = _col(error_type), _col(status_code), F.lower(F.coalesce(_col(message), F.lit("")))
    return (
        F.when(et == "TimeoutError", "timeout")
        .when(et == "RateLimitError", "rate_limited")
        .when(sc == 429, "rate_limited")
        .when(sc == 403, "blocked")
        .when(msg.contains("timeout"), "timeout")
        .when(msg.contains("blocked") | msg.contains("forbidden"), "blocked")
        .otherwise("failed")
    )


def health_score(status_code, response_time) -> Column:
    """100, −50 when not 200, −30/−15/−5 above 3/1/0.5 s, floored at 0."""
    sc, rt = _col(status_code), _col(response_time)
    penalty = F.when(rt > HEALTH_SLOW[0][0], HEALTH_SLOW[0][1])
    for limit, cost in HEALTH_SLOW[1:]:
        penalty = penalty.when(rt > limit, cost)
    penalty = penalty.otherwise(0)
    return F.greatest(
        F.lit(0), F.lit(HEALTH_START) - F.when(sc != 200, HEALTH_NOT_200).otherwise(0) - penalty
    ).cast("int")


def issues(status_code, response_time) -> Column:
    """List of issue strings."""
    sc, rt = _col(status_code), _col(response_time)
    return F.array_compact(
        F.array(
            F.when(sc != 200, F.concat(F.lit("HTTP "), sc.cast("string"), F.lit(" error"))),
            F.when(rt > 3.0, F.lit(ISSUE_VERY_SLOW)).when(rt > 1.0, F.lit(ISSUE_SLOW)),
        )
    )


def recommendations(status_code, response_time) -> Column:
    """List of recommendation strings."""
    sc, rt = _col(status_code), _col(response_time)
    return F.concat(
        F.when(sc != 200, F.array(F.lit(REC_SERVER))).otherwise(F.array().cast("array<string>")),
        F.when(rt > 1.0, F.array(*[F.lit(r) for r in REC_SLOW])).otherwise(F.array().cast("array<string>")),
    )


def engagement(likes, shares, comments) -> Column:
    """Likes + 3·shares + 2·comments, missing counts as 0."""
    wl, ws, wc = ENGAGEMENT_WEIGHTS
    return (
        F.coalesce(_col(likes), F.lit(0)) * wl
        + F.coalesce(_col(shares), F.lit(0)) * ws
        + F.coalesce(_col(comments), F.lit(0)) * wc
    )


def category(title) -> Column:
    """First category whose keyword is in the lower-cased title."""
    low = F.lower(F.coalesce(_col(title), F.lit("")))
    expr = None
    for name, words in CATEGORY_KEYWORDS:
        hit = None
        for w in words:
            c = low.contains(w)
            hit = c if hit is None else (hit | c)
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise("other")


def quality_score(title, price, description, images, availability) -> Column:
    """X17 (Q30): one point per truthy field, +0.5 for a description over 100
    characters and for more than 3 images; divided by 5, capped at 1."""
    t, p, d, im, av = (_col(x) for x in (title, price, description, images, availability))
    truthy_str = lambda c: F.when(c.isNotNull() & (c.cast("string") != ""), 1.0).otherwise(0.0)
    score = (
        truthy_str(t)
        + F.when(p.isNotNull() & (p != 0), 1.0).otherwise(0.0)
        + truthy_str(d)
        + F.when(d.isNotNull() & (F.length(d) > 100), 0.5).otherwise(0.0)
        + F.when(im.isNotNull() & (F.size(im) > 0), 1.0).otherwise(0.0)
        + F.when(im.isNotNull() & (F.size(im) > 3), 0.5).otherwise(0.0)
        + truthy_str(av)
    )
    return F.least(score / len(QUALITY_FIELDS), F.lit(1.0))


def price_conversions(price, currency) -> Column:
    """Map currency → price converted from ``currency``, 2 dp, others only."""
    rates = F.create_map(*[x for cur, r in CURRENCY_RATES for x in (F.lit(cur), F.lit(r))])
    base_rate = F.coalesce(rates[_col(currency)], F.lit(1.0))
    entries = F.array(
        *[
            F.when(_col(currency) != cur, F.struct(F.lit(cur).alias("key"), F.round(_col(price) * r / base_rate, 2).alias("value")))
            for cur, r in CURRENCY_RATES
        ]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))


def success_score(status_code, values, variant: str = "nonempty") -> Column:
    """0.3 for 200 (0.2 other 2xx) + 0.7 · share of non-empty selector
    values, capped at 1.  ``values`` is ``array<string>`` (NULL = no hit).

    ``variant='strict200'``: other 2xx earn nothing and '[]' counts as data.
    """
    sc, v = _col(status_code), _col(values)
    if variant == "strict200":
        base = F.when(sc == 200, 0.3).otherwise(0.0)
        filled = F.filter(v, lambda x: x.isNotNull())
    else:
        base = F.when(sc == 200, 0.3).when((sc >= 200) & (sc < 300), 0.2).otherwise(0.0)
        filled = F.filter(v, lambda x: x.isNotNull() & (x != "") & (x != "[]"))
    share = F.when(F.size(v) > 0, 0.7 * F.size(filled) / F.size(v)).otherwise(0.0)
    return F.least(F.lit(1.0), base + share)


def data_completeness(values, n_selectors) -> Column:
    """Non-null values / selectors; 1 when there are no selectors, 0 when no data."""
    v, n = _col(values), _col(n_selectors)
    return (
        F.when(n == 0, 1.0)
        .when(v.isNull() | (F.size(v) == 0), 0.0)
        .otherwise(F.size(F.filter(v, lambda x: x.isNotNull())) / n)
    )


def extraction_quality(title, n_paragraphs, n_links) -> Column:
    """Title .4 + paragraphs .3 + links .2 + .1 base."""
    return (
        F.when(F.coalesce(F.length(_col(title)), F.lit(0)) > 0, 0.4).otherwise(0.0)
        + F.when(_col(n_paragraphs) > 0, 0.3).otherwise(0.0)
        + F.when(_col(n_links) > 0, 0.2).otherwise(0.0)
        + 0.1
    )


def proxy_status(health, rule: str = "per_result") -> Column:
    """Status from health; ``per_result`` (<.3 blocked, <.5 limited, else
    active) or ``sweep`` (<.2, <.4, else active)."""
    thresholds = PROXY_STATUS_PER_RESULT if rule == "per_result" else PROXY_STATUS_SWEEP
    h = _col(health)
    expr = F.when(h < thresholds[0][0], thresholds[0][1])
    for limit, name in thresholds[1:]:
        expr = expr.when(h < limit, name)
    return expr.otherwise("active")


def proxy_id(host, port, proxy_type) -> Column:
    """``host:port:type``."""
    return F.concat_ws(":", _col(host), _col(port).cast("string"), _col(proxy_type))


def proxy_url(proxy_type, host, port, username=None, mask: bool = True) -> Column:
    """Proxy URL; credentials are masked by default."""
    base = F.concat(_col(proxy_type), F.lit("://"))
    hostport = F.concat(_col(host), F.lit(":"), _col(port).cast("string"))
    if username is None:
        return F.concat(base, hostport)
    cred = F.concat(_col(username), F.lit(":***@")) if mask else F.concat(_col(username), F.lit("@"))
    return F.when(_col(username).isNotNull(), F.concat(base, cred, hostport)).otherwise(F.concat(base, hostport))


def ipv4_valid(ip) -> Column:
    """Four dot-separated integers 0–255."""
    parts = F.split(F.coalesce(_col(ip), F.lit("")), r"\.")
    return (F.size(parts) == 4) & F.forall(
        parts, lambda p: p.rlike(r"^[0-9]+$") & (p.try_cast("int") >= 0) & (p.try_cast("int") <= 255)
    )


def server_health(load) -> Column:
    """``1 - load/100``."""
    return 1 - _col(load) / 100


def validation_errors(status, error_message, data, required: list[str], number_fields: list[str], url_fields: list[str]):
    """(errors, warnings) arrays for one result.

    ``data`` is a ``map<string,string>``; a required field that is missing or
    empty is an error; a number/url field that does not parse is a warning;
    a failed scrape is a single error.
    """
    d = _col(data)
    failed = _col(status) != "success"
    errs = [
        F.when(d[F.lit(f)].isNull() | (d[F.lit(f)] == ""), F.lit(f"Missing required field: {f}")) for f in required
    ]
    warns = [
        F.when(
            d[F.lit(f)].isNotNull() & d[F.lit(f)].try_cast("double").isNull(),
            F.concat(F.lit(f"Field '{f}' should be numeric but got: "), d[F.lit(f)]),
        )
        for f in number_fields
    ] + [
        F.when(
            d[F.lit(f)].isNotNull() & ~urls.is_valid_url(d[F.lit(f)]),
            F.concat(F.lit(f"Field '{f}' contains invalid URL: "), d[F.lit(f)]),
        )
        for f in url_fields
    ]
    empty = F.array().cast("array<string>")
    errors = F.when(
        failed, F.array(F.concat(F.lit("Scrape failed: "), F.coalesce(_col(error_message), F.lit("None"))))
    ).otherwise(F.array_compact(F.array(*errs)) if errs else empty)
    warnings = F.when(failed, empty).otherwise(F.array_compact(F.array(*warns)) if warns else empty)
    return errors, warnings
