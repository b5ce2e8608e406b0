"""Column-level text helpers.  All are built-in Spark expressions, so they
stay inside whole-stage codegen; none is a Python UDF."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's rules) -----------------------
# Network location as Python's urlsplit() defines it: optional scheme
# (letter, then letters/digits/+/-/.), a colon, then "//" and everything up
# to the first "/", "?" or "#".  No "//" means an empty netloc.
NETLOC_PATTERN = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
# Word tokens: maximal runs of letters and digits on lower-cased text.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# Ellipsis appended by truncate_text.
ELLIPSIS = "..."
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_domain(url) -> Column:
    """Python ``urlparse(url).netloc`` semantics as a JVM expression.

    Case, userinfo and port are kept (unlike ``parse_url``).  A netloc with
    an unbalanced ``[``/``]`` makes Python raise, which the reference maps
    to ``''``; null maps to ``''`` as well.
    """
    u = _col(url)
    net = F.regexp_extract(u, NETLOC_PATTERN, 1)
    has_open = F.instr(net, "[") > 0
    has_close = F.instr(net, "]") > 0
    unbalanced = (has_open & ~has_close) | (has_close & ~has_open)
    return F.when(u.isNull(), F.lit("")).when(unbalanced, F.lit("")).otherwise(net)


def truncate_text(text, max_length: int = 1000) -> Column:
    """null -> ''; length <= n unchanged; else the first n-3 characters + '...'."""
    if max_length < 4:
        raise ValueError("truncate_text needs max_length >= 4")
    t = _col(text)
    return (F.when(t.isNull(), F.lit(""))
            .when(F.length(t) <= max_length, t)
            .otherwise(F.concat(F.substring(t, 1, max_length - 3), F.lit(ELLIPSIS))))


def tokenize(text) -> Column:
    """array<string> of word tokens of lower(text)."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_PATTERN), 0)


def strip_ws(text) -> Column:
    """Python ``str.strip()``: removes all leading/trailing whitespace (Spark
    ``trim`` removes spaces only)."""
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def has_han(text) -> Column:
    """True when the text holds at least one Han (Chinese) character."""
    return _col(text).rlike(r"\p{IsHan}")


def word_count(text) -> Column:
    """Number of word tokens (letters/digits runs)."""
    return F.size(F.regexp_extract_all(_col(text), F.lit(TOKEN_PATTERN), 0))


def han_count(text) -> Column:
    return F.size(F.regexp_extract_all(_col(text), F.lit(r"\p{IsHan}"), 0))


def explode_rows(df, keep, arr, name: str, pos: str | None = None):
    """Explode ``arr`` into rows, dropping empty arrays.

    Uses ``explode_outer`` + a filter on the generated column instead of
    ``explode``: for ``explode`` Catalyst infers ``size(arr) > 0`` and pushes
    that predicate below any repartition into the scan, evaluating the
    (expensive, regex-built) array twice -- once before the rows are spread
    over the cluster.
    """
    keep = [F.col(k) if isinstance(k, str) else k for k in keep]
    if pos is None:
        return df.select(*keep, F.explode_outer(arr).alias(name)).filter(F.col(name).isNotNull())
    return (df.select(*keep, F.posexplode_outer(arr).alias(pos, name))
            .filter(F.col(pos).isNotNull()))
