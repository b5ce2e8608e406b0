"""Column helpers: URL netloc, truncation, strip, tokenizer (FIXTURES.md §1-2)."""
import pytest

from tessera.functions.text import extract_domain, has_han, strip_ws, tokenize, truncate_text

# URL -> network location: www host, second-level host, bare host, empty and
# non-URL texts, and what urlparse was measured to do with odd ones.
DOMAIN_CASES = [
    ("https://www.harbour-notes.net/2031/tides?x=1", "www.harbour-notes.net"),
    ("http://maps.city.gov.au/wards", "maps.city.gov.au"),
    ("https://lighthouse.museum", "lighthouse.museum"),
    ("", ""),
    ("plain words", ""),
    ("//cdn.x.org/a", "cdn.x.org"),
    ("https://u:p@Host.COM:8080/x?y#z", "u:p@Host.COM:8080"),
    ("https://a_b.com/x y", "a_b.com"),
    ("https://例え.jp/ü", "例え.jp"),
    ("mailto:a@b", ""),
    ("https:///nohost", ""),
    ("https://[bad", ""),
    (None, ""),
]


def test_extract_domain(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(DOMAIN_CASES)], "i int, url string")
    got = {r.i: r.d for r in df.select("i", extract_domain("url").alias("d")).collect()}
    for i, (u, want) in enumerate(DOMAIN_CASES):
        assert got[i] == want, (u, got[i], want)


def test_truncate_text(spark):
    df = spark.createDataFrame([("abcdefgh",), ("abcde",), (None,)], "t string")
    got = [r[0] for r in df.select(truncate_text("t", 5)).collect()]
    assert got == ["ab...", "abcde", ""]
    with pytest.raises(ValueError):
        truncate_text("t", 3)


def test_strip_and_tokens(spark):
    df = spark.createDataFrame([("\n\t Hello, World 42!  \n",)], "t string")
    r = df.select(strip_ws("t").alias("s"), tokenize("t").alias("k"), has_han("t").alias("h")).first()
    assert r.s == "Hello, World 42!"
    assert r.k == ["hello", "world", "42"]
    assert r.h is False
    assert spark.createDataFrame([("关于MCP",)], "t string").select(has_han("t")).first()[0] is True
