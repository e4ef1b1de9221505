"""Column-level helpers: null rules, text, arrays and JSON (all JVM-side).

Each helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def C(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- null rules

def nan_to_null(c) -> Column:
    """NaN is missing (pandas): turn it into NULL so aggregates skip it."""
    c = C(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def safe_div(a, b) -> Column:
    """x/0 -> NULL instead of an ANSI error (pandas gives inf/NaN)."""
    return F.try_divide(C(a), C(b))


def lt_flag(c, bound) -> Column:
    """(x < bound) as 0/1 with missing -> 0."""
    return F.coalesce((C(c) < F.lit(bound)).cast("int"), F.lit(0))


def clip_lower(c, lo=0) -> Column:
    """max(x, lo) that keeps NULL as NULL (greatest() would return lo)."""
    c = C(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(c, F.lit(lo)))


def signed_log1p(c) -> Column:
    c = C(c)
    return F.signum(c) * F.log1p(F.abs(c))


def safe_log(c) -> Column:
    """Natural log, NULL for non-positive input."""
    c = C(c)
    return F.when(c > 0, F.ln(c))


def row_sum(cols) -> Column:
    """Row-wise sum skipping NULLs (all NULL -> 0, as pandas sum(axis=1))."""
    return sum((F.coalesce(C(c), F.lit(0.0)) for c in cols), F.lit(0.0))


def row_mean(cols) -> Column:
    """Row-wise mean over non-null members; all NULL -> NULL."""
    n = sum((C(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return F.try_divide(row_sum(cols), n.cast("double"))


def null_count(cols) -> Column:
    return sum((C(c).isNull().cast("int") for c in cols), F.lit(0))


def frac_days(later, earlier) -> Column:
    """Fractional days between two timestamps (julianday difference)."""
    return F.timestamp_diff("MICROSECOND", C(earlier), C(later)) / F.lit(86400e6)


# ---------------------------------------------------------------- text

def contains_ci(c, pattern: str) -> Column:
    """Case-folded substring test with NULL -> false."""
    return F.coalesce(F.lower(C(c)).contains(pattern.lower()), F.lit(False))


def list_codes(c, sep: str = ",", code_sep: str = " - ") -> Column:
    """'a - x,b - y' -> ['a', 'b']: split a list text, keep the code before code_sep."""
    parts = F.split(C(c), sep)
    return F.transform(parts, lambda x: F.trim(F.split(x, code_sep, -1)[0]))


def first_tree_level(c) -> Column:
    """First category of a '["A >> B >> C"]' tree string, trimmed."""
    return F.nullif(F.regexp_extract(C(c), r'(?<=\[")\s*([^>]+?)\s*(?=>>)', 1), F.lit(""))


def url_words(c, prefix: str = "") -> Column:
    """Strip a prefix and turn runs of non-word characters into one space."""
    u = C(c)
    if prefix:
        u = F.replace(u, F.lit(prefix), F.lit(""))
    return F.regexp_replace(u, r"(\W|_)+", " ")


def concat_text(cols, sep: str = ". ") -> Column:
    """Join text fields with a separator; a missing field counts as ''."""
    return F.concat_ws(sep, *[F.coalesce(C(c), F.lit("")) for c in cols])


def truncate(c, n: int) -> Column:
    return F.left(C(c), F.lit(n))


def tokens(c) -> Column:
    """Lower-case tokens: maximal runs of two or more Unicode word characters (letters, digits, '_')."""
    return F.regexp_extract_all(F.lower(C(c)), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def parse_labels(c, labels: list[str], k: int = 3) -> Column:
    """Ranked labels from free text.

    1. first bracketed block parsed as a JSON string array, items upper-cased
       and trimmed, only valid labels kept, first k;
    2. otherwise the valid labels that occur in the upper-cased text, in the
       order of ``labels``, first k;
    3. otherwise an empty array.
    """
    valid = F.array(*[F.lit(x) for x in labels])
    block = F.regexp_extract(C(c), r"(?s)\[.*?\]", 0)
    parsed = F.from_json(F.when(block != "", block), "array<string>")
    cleaned = F.filter(F.transform(parsed, lambda x: F.upper(F.trim(x))),
                       lambda x: F.array_contains(valid, x))
    upper = F.upper(F.trim(C(c)))
    found = F.filter(valid, lambda x: F.contains(upper, x))
    json_pick = F.when(F.size(cleaned) > 0, F.slice(cleaned, 1, k))
    text_pick = F.when(F.size(found) > 0, F.slice(found, 1, k))
    return F.coalesce(json_pick, text_pick, F.array().cast("array<string>"))


def reciprocal_rank(true_col, preds_col) -> Column:
    """1/position of the true label in the prediction list, 0 when absent."""
    pos = F.array_position(C(preds_col), C(true_col))
    return F.when(pos > 0, F.lit(1.0) / pos).otherwise(F.lit(0.0))


def impact_label(c, pos: str = "increases risk", neg: str = "decreases risk") -> Column:
    return F.when(C(c) > 0, F.lit(pos)).otherwise(F.lit(neg))


def display_name(c, prefix: str = "shap_") -> Column:
    """'shap_ext_source_1' -> 'Ext Source 1'."""
    return F.initcap(F.replace(F.regexp_replace(C(c), "^" + prefix, ""), F.lit("_"), F.lit(" ")))


# ---------------------------------------------------------------- vectors

def l2_norm(c) -> Column:
    return F.sqrt(F.aggregate(C(c), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(c) -> Column:
    n = l2_norm(c)
    return F.transform(C(c), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def sq_dist(a, b) -> Column:
    return F.aggregate(F.zip_with(C(a), C(b), lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(C(a), C(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def top_k_entries(values_col, names: list[str], k: int, by_abs: bool = False) -> Column:
    """Top-k (name, value) structs of an array column, largest first.

    Ties keep the earlier name first.
    """
    vals = C(values_col)
    idx = F.sequence(F.lit(0), F.size(vals) - 1)
    nm = F.array(*[F.lit(n) for n in names])
    s = F.transform(idx, lambda i: F.struct(
        (F.abs(vals[i]) if by_abs else vals[i]).alias("key"),
        (-i).alias("tie"), nm[i].alias("name"), vals[i].alias("value")))
    top = F.slice(F.sort_array(s, asc=False), 1, k)
    return F.transform(top, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
