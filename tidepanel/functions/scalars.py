"""Column expressions: coercion, text amounts, codes, blanks, bands, labels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for a missing amount, a blank field or a false flag.
EMPTY_AMOUNTS = ("", "-", "--", "nan", "None")
BLANK_WORDS = ("", "nan", "none", "null")
UNKNOWN_WORDS = ("未知", "无", "--", "-")
NO_TEXT_WORDS = ("nan", "none", "nat")
FALSE_WORDS = ("0", "false", "no", "off", "否")


def number(c: str | Column) -> Column:
    """Text or number to double; what does not parse and NaN become null."""
    c = F.col(c) if isinstance(c, str) else c
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def with_defaults(df: DataFrame, spec: dict[str, tuple[str, object]]) -> DataFrame:
    """Declare columns: ``spec`` maps name -> (type, default). Absent columns are added,
    present ones coerced, nulls replaced when the default is not None."""
    out = {}
    for name, (dtype, default) in spec.items():
        base = F.col(name) if name in df.columns else F.lit(None)
        value = number(base) if dtype == "double" and name in df.columns else base.cast(dtype)
        out[name] = value if default is None else F.coalesce(value, F.lit(default).cast(dtype))
    return df.withColumns(out)


def first_existing(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def parse_amount(c: str | Column) -> Column:
    """Amounts such as ``1.2亿``, ``-35万元``, ``1,234``; anything else is 0."""
    raw = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    text = F.regexp_replace(raw, "[,，]", "")
    body = F.regexp_replace(text, "[+-]", "")
    unit = F.when(body.contains("亿"), 1e8).when(body.contains("万"), 1e4).otherwise(1.0)
    digits = F.trim(F.regexp_replace(body, "亿元|亿|万元|万|元", ""))
    value = digits.try_cast("double") * unit
    signed = F.when(text.startswith("-"), -value).otherwise(value)
    return F.when(raw.isNull() | text.isin(*EMPTY_AMOUNTS), 0.0).otherwise(F.coalesce(signed, F.lit(0.0)))


def parse_percent(c: str | Column) -> Column:
    raw = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    value = F.regexp_replace(raw, "[%,]", "").try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))


def to_yi(c: str | Column) -> Column:
    """Plain units to hundreds of millions, three places."""
    return F.round((F.col(c) if isinstance(c, str) else c) / 1e8, 3)


def is_blank(c: str | Column, unknown_too: bool = False) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    words = BLANK_WORDS + (UNKNOWN_WORDS if unknown_too else ())
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*words)


def clean_text(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(c.cast("string"))
    return F.when(text.isNull() | F.lower(text).isin(*NO_TEXT_WORDS), "").otherwise(text)


def to_bool(c: str | Column, default: bool = True) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isNull(), F.lit(default)).otherwise(~text.isin(*FALSE_WORDS))


def first_positive(cols: Iterable[str]) -> Column:
    return F.coalesce(*[F.when(F.col(c) > 0, F.col(c)) for c in cols], F.lit(0.0))


def bare_code(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lpad(F.split_part(c, F.lit("."), F.lit(1)), 6, "0")


def exchange_suffix(c: str | Column) -> Column:
    """Six digits to a code with market suffix; codes that carry one are kept."""
    c = F.col(c) if isinstance(c, str) else c
    return (
        F.when(c.isNull() | (c == ""), "")
        .when(c.contains("."), c)
        .when(c.rlike("^[69]"), F.concat(c, F.lit(".SH")))
        .when(c.rlike("^[48]"), F.concat(c, F.lit(".BJ")))
        .otherwise(F.concat(c, F.lit(".SZ")))
    )


def board_kept(code: str, drop_growth: bool, drop_star: bool) -> Column:
    """False for growth-board (300/301) and star-board (688/689) codes when excluded."""
    head = F.substring(F.col(code), 1, 3)
    keep = F.lit(True)
    if drop_growth:
        keep = keep & ~head.isin("300", "301")
    if drop_star:
        keep = keep & ~head.isin("688", "689")
    return keep


def special_treatment(name: str | Column) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(name.contains("ST") | name.contains("退"), F.lit(False))


def band_score(v: Column, lo: float, hi: float, soft_lo: float | None = None, soft_hi: float | None = None) -> Column:
    """100 inside [lo, hi], falling linearly to 0 at the soft bounds."""
    soft_lo = lo * 0.5 if soft_lo is None else soft_lo
    soft_hi = hi * 1.5 if soft_hi is None else soft_hi
    v = F.coalesce(v, F.lit(0.0))
    below = F.when(v <= soft_lo, 0.0).otherwise((v - soft_lo) / (lo - soft_lo) * 100)
    above = F.when(v >= soft_hi, 0.0).otherwise((soft_hi - v) / (soft_hi - hi) * 100)
    return F.when((v >= lo) & (v <= hi), 100.0).when(v < lo, below).otherwise(above)


def bound(c: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def join_reasons(parts: Sequence[Column], sep: str = " | ") -> Column:
    """Distinct non-empty reasons in order."""
    return F.array_join(F.array_distinct(F.filter(F.array_compact(F.array(*parts)), lambda x: x != "")), sep)


def repair_mojibake(c: str, markers: str) -> Column:
    """UTF-8 text that was decoded as Latin-1: decode again where markers show it."""
    again = F.decode(F.encode(F.col(c), "ISO-8859-1"), "UTF-8")
    return F.when(F.col(c).rlike(markers), again).otherwise(F.col(c))


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson aggregate over complete pairs; null where a side is constant (the built-in
    raises a division error there in ANSI mode)."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
