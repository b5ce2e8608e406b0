"""DuckDB SQL twins of :mod:`tessera.plans.derived` (oracle side only).

Each function returns a list of ``name AS (...)`` CTE fragments; ``sql()``
joins them into one ``WITH`` statement.  Patterns are the same strings the
Spark code uses (RE2 and Java regex agree on every construct used here;
DuckDB needs the ``'g'`` flag for a global replace).
"""
from __future__ import annotations

from tessera.functions.text import NETLOC_PATTERN, TOKEN_PATTERN
from tessera.operators.retrieve import BM25_B, BM25_K1
from tessera.sources.pages import (ANCHOR_PATTERN, COMMENT_PATTERN, NON_TEXT_BLOCKS,
                                   TAG_PATTERN, TITLE_PATTERN, WS_PATTERN)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql(ctes: list[str], select: str) -> str:
    seen, out = set(), []
    for c in ctes:
        name = c.split(" AS (", 1)[0].strip()
        if name not in seen:
            seen.add(name)
            out.append(c)
    return ("WITH " + ",\n".join(out) + "\n" + select) if out else select


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {q(TOKEN_PATTERN)})"


def domain(expr: str) -> str:
    net = f"regexp_extract({expr}, {q(NETLOC_PATTERN)}, 1)"
    return (f"(CASE WHEN {expr} IS NULL THEN '' "
            f"WHEN (strpos({net}, '[') > 0) <> (strpos({net}, ']') > 0) THEN '' ELSE {net} END)")


def truncate(expr: str, n: int) -> str:
    return (f"(CASE WHEN {expr} IS NULL THEN '' WHEN length({expr}) <= {n} THEN {expr} "
            f"ELSE substring({expr}, 1, {n - 3}) || '...' END)")


def requests() -> list[str]:
    return ["""requests AS (SELECT item_id AS query_id, text AS query,
  CAST(CASE item_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 80 WHEN 2 THEN 10 WHEN 3 THEN 25
       WHEN 4 THEN -1 ELSE 3 END AS BIGINT) AS top_k,
  CASE item_id % 7 WHEN 0 THEN 'day' WHEN 1 THEN 'week' WHEN 2 THEN 'month' WHEN 3 THEN 'year'
       WHEN 4 THEN 'decade' ELSE NULL END AS time_range,
  CASE item_id % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'news' ELSE 'finance' END AS topic,
  CASE item_id % 2 WHEN 0 THEN 'basic' ELSE 'advanced' END AS search_depth,
  (item_id % 4 = 0) AS include_images
FROM benchmark)"""]


def params() -> list[str]:
    return requests() + ["""params AS (SELECT query_id, query,
  least(coalesce(top_k, 5), 50) AS max_results, topic, search_depth,
  CASE WHEN time_range IN ('day', 'week', 'month', 'year') THEN time_range END AS time_range,
  CASE WHEN include_images THEN TRUE END AS include_images,
  CASE WHEN include_images THEN TRUE END AS include_image_descriptions,
  FALSE AS include_answer, FALSE AS include_raw_content
FROM requests)"""]


def page_text(expr: str = "html") -> str:
    t = f"regexp_replace({expr}, {q(COMMENT_PATTERN)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(NON_TEXT_BLOCKS)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(TAG_PATTERN)}, ' ', 'g')"
    return f"trim(regexp_replace({t}, {q(WS_PATTERN)}, ' ', 'g'))"


def page_results() -> list[str]:
    return [f"""page_results AS (SELECT page_id, url,
  trim(regexp_extract(html, {q(TITLE_PATTERN)}, 1)) AS title,
  {page_text()} AS content FROM pages)"""]


def page_links() -> list[str]:
    return [f"""page_links AS (
  SELECT page_id, CAST(generate_subscripts(h, 1) AS BIGINT) AS pos, unnest(h) AS href, unnest(a) AS anchor
  FROM (SELECT page_id, regexp_extract_all(html, {q(ANCHOR_PATTERN)}, 1) AS h,
               regexp_extract_all(html, {q(ANCHOR_PATTERN)}, 2) AS a FROM pages))"""]


def bm25(name: str, corpus: str, id_col: str, text_col: str, reqs: str = "params",
         k1: float = BM25_K1, b: float = BM25_B) -> list[str]:
    """CTE ``name``: (query_id, <id_col>, score) for every matching document."""
    p = name
    return [
        f"{p}_docs AS (SELECT {id_col} AS _id, {tokens(text_col)} AS toks FROM {corpus})",
        f"{p}_dl AS (SELECT _id, CAST(len(toks) AS DOUBLE) AS dl FROM {p}_docs)",
        f"{p}_stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM {p}_dl)",
        f"{p}_qt AS (SELECT DISTINCT query_id, unnest({tokens('query')}) AS term FROM {reqs})",
        f"{p}_tok AS (SELECT _id, unnest(toks) AS term FROM {p}_docs)",
        f"{p}_post AS (SELECT _id, term, CAST(count(*) AS DOUBLE) AS tf FROM {p}_tok "
        f"WHERE term IN (SELECT term FROM {p}_qt) GROUP BY _id, term)",
        f"{p}_df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM {p}_post GROUP BY term)",
        f"""{p}_c AS (SELECT q.query_id, p._id,
   ln(1.0 + (s.n - d.df + 0.5) / (d.df + 0.5)) * (p.tf * {k1 + 1.0})
   / (p.tf + {k1} * ({1.0 - b} + {b} * l.dl / s.avgdl)) AS c
 FROM {p}_qt q JOIN {p}_post p ON q.term = p.term JOIN {p}_df d ON d.term = p.term
 JOIN {p}_dl l ON l._id = p._id CROSS JOIN {p}_stats s)""",
        f"{p} AS (SELECT query_id, _id AS {id_col}, round(sum(c), 4) AS score FROM {p}_c GROUP BY query_id, _id)",
    ]


def topk(name: str, src: str, id_col: str, reqs: str = "params") -> list[str]:
    """CTE ``name``: src capped by max_results -> (query_id, id, score, rank)."""
    return [f"""{name} AS (SELECT query_id, {id_col}, score, rank FROM (
  SELECT s.query_id, s.{id_col}, s.score, CAST(row_number() OVER (PARTITION BY s.query_id
         ORDER BY s.score DESC, s.{id_col}) AS BIGINT) AS rank, r.max_results
  FROM {src} s JOIN {reqs} r ON r.query_id = s.query_id) t
  WHERE rank <= max_results AND rank <= 50)"""]


def doc_search() -> list[str]:
    return params() + bm25("doc_bm25", "documents", "doc_id", "text") + topk("doc_search", "doc_bm25", "doc_id")


def web_search() -> list[str]:
    return (params() + page_results() + bm25("web_bm25", "page_results", "page_id", "content")
            + topk("web_search", "web_bm25", "page_id"))


def web_raw() -> list[str]:
    return web_search() + ["""web_raw AS (SELECT h.query_id, h.rank, h.page_id, p.url, p.title, p.content,
  h.score, CASE WHEN h.page_id % 2 = 0 THEN p.content END AS raw_content
FROM web_search h JOIN page_results p ON p.page_id = h.page_id)"""]


def web_results() -> list[str]:
    return web_raw() + [f"""web_results AS (SELECT query_id, rank, page_id,
  coalesce(url, '') AS url, coalesce(title, '') AS title, coalesce(content, '') AS snippet,
  coalesce(CAST(score AS DOUBLE), 0.0) AS score, '' AS published_date,
  {domain("coalesce(url, '')")} AS domain,
  CASE WHEN raw_content IS NOT NULL THEN {truncate('raw_content', 500)} END AS raw_content
FROM web_raw)"""]


def web_images() -> list[str]:
    return web_search() + page_links() + ["""web_images AS (SELECT h.query_id,
  CAST(h.rank * 100000 + l.pos AS BIGINT) AS img_pos, l.href AS url, l.anchor AS description
FROM web_search h JOIN page_links l ON l.page_id = h.page_id)"""]


def responses_kind() -> list[str]:
    return ["""resp AS (SELECT doc_id AS query_id, doc_id, source, text, n_chars,
  CASE WHEN lang = 'de' AND doc_id % 2 = 0 THEN 'other' WHEN source = 'src7' THEN 'bad'
       WHEN lang = 'es' THEN 'null' ELSE 'object' END AS kind FROM documents)"""]


def parsed_results() -> list[str]:
    return responses_kind() + ["""parsed AS (
  SELECT query_id, CAST(1 AS BIGINT) AS rank,
    'https://' || source || '.example.org/doc/' || CAST(doc_id AS VARCHAR) AS url,
    split_part(text, chr(10), 1) AS title, text AS content, CAST(n_chars AS DOUBLE) / 1000.0 AS score,
    '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS published_date,
    CAST(NULL AS VARCHAR) AS raw_content, source IS NOT NULL AS has_url,
    split_part(text, chr(10), 1) IS NOT NULL AS has_title, text IS NOT NULL AS has_content
  FROM resp WHERE kind = 'object'
  UNION ALL
  SELECT query_id, CAST(2 AS BIGINT),
    'https://mirror.' || source || '.example.org/doc/' || CAST(doc_id AS VARCHAR),
    CASE WHEN doc_id % 3 <> 0 THEN 'Mirror ' || CAST(doc_id AS VARCHAR) END,
    'copy of ' || CAST(doc_id AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR),
    CAST(NULL AS VARCHAR), TRUE, doc_id % 3 <> 0, TRUE
  FROM resp WHERE kind = 'object')""",
        """parsed_errors AS (SELECT query_id, CASE kind WHEN 'bad' THEN 'search failed: invalid JSON response'
  ELSE 'search failed: unexpected response type' END AS error FROM resp WHERE kind IN ('bad', 'other'))"""]


def expanded_search() -> list[str]:
    return params() + ["""expanded AS (SELECT query_id * 10 + a.pos AS query_id, query || a.suffix AS query, max_results
  FROM params CROSS JOIN (VALUES (0, ''), (1, ' analysis'), (2, ' overview')) a(pos, suffix))"""] + \
        bm25("exp_bm25", "documents", "doc_id", "text", reqs="expanded") + \
        ["""exp_search AS (SELECT query_id // 10 AS query_id, doc_id, score FROM (
  SELECT b.query_id, b.doc_id, b.score, e.max_results,
         row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, b.doc_id) AS rank
  FROM exp_bm25 b JOIN expanded e ON e.query_id = b.query_id) WHERE rank <= max_results AND rank <= 50)"""]


def host(expr: str) -> str:
    return f"regexp_replace(regexp_replace(lower({expr}), '^.*@', ''), ':[0-9]*$', '')"


def tier_case(expr: str, tiers) -> str:
    h = host(expr)
    parts = []
    for t in sorted({t for _, t in tiers}):
        conds = " OR ".join(f"({h} = {q(s)} OR suffix({h}, {q('.' + s)}))" for s, tt in tiers if tt == t)
        parts.append(f"WHEN {conds} THEN CAST({t} AS BIGINT)")
    return "(CASE " + " ".join(parts) + " END)"


def web_tiered() -> list[str]:
    from tessera.plans.derived import TIER_PARAMS
    return web_results() + [f"web_tiered AS (SELECT *, {tier_case('domain', TIER_PARAMS)} AS tier FROM web_results)"]


def tier_weight(expr: str) -> str:
    return f"CAST(CASE {expr} WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.6 ELSE 0.2 END AS DOUBLE)"


def sentences_sql(src: str, id_col: str, text_col: str) -> str:
    from tessera.operators.summarise import SENTENCE_PATTERN
    return f"""SELECT {id_col}, CAST(generate_subscripts(s, 1) AS BIGINT) AS sent_pos, trim(unnest(s)) AS sentence
  FROM (SELECT {id_col}, regexp_extract_all({text_col}, {q(SENTENCE_PATTERN)}) AS s FROM {src})"""


def phrase_requests() -> list[str]:
    return params() + [f"""phrase_req AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN
    query || coalesce(' "' || t[1] || ' ' || t[2] || '"', '') ELSE query END AS query
  FROM (SELECT query_id, query, {tokens('query')} AS t FROM params))"""]


def doc_sentences() -> list[str]:
    from tessera.operators.summarise import SENTENCE_PATTERN
    return [f"""doc_sent_raw AS (SELECT doc_id, CAST(generate_subscripts(s, 1) AS BIGINT) AS sent_pos,
    trim(unnest(s)) AS sentence FROM (SELECT doc_id, regexp_extract_all(text, {q(SENTENCE_PATTERN)}) AS s FROM documents))""",
            f"""doc_sent AS (SELECT doc_id, sent_pos, sentence, CAST(len({tokens('sentence')}) AS BIGINT) AS n_tokens
  FROM doc_sent_raw WHERE sentence <> '')"""]


def doc_facts() -> list[str]:
    from tessera.operators.summarise import DATE_PATTERN, FACT_PATTERN
    return doc_sentences() + [f"""doc_facts AS (SELECT doc_id, sent_pos, fact_pos, fact,
    CASE WHEN suffix(fact, '%') THEN 'percent' WHEN regexp_matches(fact, {q(DATE_PATTERN)}) THEN 'date'
         ELSE 'number' END AS kind
  FROM (SELECT doc_id, sent_pos, CAST(generate_subscripts(f, 1) AS BIGINT) AS fact_pos, unnest(f) AS fact
        FROM (SELECT doc_id, sent_pos, regexp_extract_all(sentence, {q(FACT_PATTERN)}) AS f FROM doc_sent)))"""]


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def reports() -> list[str]:
    from tessera.operators.report import SECTION_ORDER
    names = "[" + ", ".join(q(s) for s in SECTION_ORDER[:6]) + "]"
    order = "[" + ", ".join(q(s) for s in SECTION_ORDER) + "]"
    nl2 = "chr(10) || chr(10)"
    ref_line = ("CASE WHEN r.report_id % 7 = 0 THEN CAST(n AS VARCHAR) || '. Source ' || CAST(n AS VARCHAR) "
                "ELSE CAST(n AS VARCHAR) || '. [Source ' || CAST(n AS VARCHAR) || '](https://' || d.source || "
                "'.example.org/' || CAST(r.report_id AS VARCHAR) || '/' || CAST(n AS VARCHAR) || ')' END || ' - ' || "
                "d.source || ', 2024-01-0' || CAST(n AS VARCHAR)")
    return [
        """rep_lines AS (SELECT doc_id AS report_id, CAST(generate_subscripts(l, 1) AS BIGINT) AS para_pos,
  unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
        f"""rep_paras AS (SELECT report_id, {names}[least(para_pos, 6)] AS section, para_pos,
  line || ' [' || CAST((para_pos - 1) % 3 + 1 AS VARCHAR) || ']' AS para FROM rep_lines WHERE line <> ''
  UNION ALL SELECT report_id, 'Key Findings', CAST(0 AS BIGINT), '### Highlights' FROM rep_lines
  WHERE para_pos = 3 AND line <> '' AND report_id % 6 <> 0)""",
        f"""rep_secs AS (SELECT report_id, section, string_agg(para, {nl2} ORDER BY para_pos) AS b
  FROM rep_paras GROUP BY report_id, section)""",
        f"""rep_body0 AS (SELECT report_id, '# Report ' || CAST(report_id AS VARCHAR) || {nl2} ||
  string_agg('## ' || section || {nl2} || b, {nl2} ORDER BY list_position({order}, section)) AS body
  FROM rep_secs GROUP BY report_id)""",
        f"""reports AS (SELECT r.report_id, d.lang, d.source, r.body ||
  CASE WHEN r.report_id % 8 = 4 THEN {nl2} || '![](https://img.example.org/' || CAST(r.report_id AS VARCHAR) || '.png)'
       WHEN r.report_id % 4 = 0 THEN {nl2} || '![Figure for ' || CAST(r.report_id AS VARCHAR) ||
         '](https://img.example.org/' || CAST(r.report_id AS VARCHAR) || '.png)' || chr(10) ||
         '*Figure 1: Overview of report ' || CAST(r.report_id AS VARCHAR) || '*' ELSE '' END ||
  CASE WHEN nr > 0 THEN {nl2} || '## References' || {nl2} ||
    array_to_string(list_transform(range(1, nr + 1), lambda n: {ref_line}), chr(10)) ELSE '' END AS body
FROM (SELECT *, CASE report_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 3 END AS nr FROM rep_body0) r
JOIN (SELECT doc_id, lang, source FROM documents) d ON d.doc_id = r.report_id)""",
    ]


def crc32(expr: str, table: str = "crc") -> str:
    """CRC-32 of a string's UTF-8 bytes; ``table`` is the list of :func:`crc_table`."""
    h = f"hex(encode({expr}))"
    bytes_ = f"list_transform(range(0, (length({h}) // 2)), lambda i: ('0x' || substr({h}, 2 * i::INT + 1, 2))::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295, {bytes_}), "
            f"lambda a, b: xor(a >> 8, {table}[(xor(a, b) & 255) + 1])), 4294967295)")


def crc_table() -> list[str]:
    """``crc_table``: one row with the list ``crc`` of the 256 remainders, from the polynomial."""
    step = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    out = ["crc_0 AS (SELECT range AS i, range AS v FROM range(256))"]
    out += [f"crc_{k} AS (SELECT i, {step} AS v FROM crc_{k - 1})" for k in range(1, 9)]
    return [*out, "crc_table AS (SELECT list(v ORDER BY i) AS crc FROM crc_8)"]


def tfidf(name: str, corpus: str, id_col: str, text_col: str, dims: int, like: str | None = None) -> list[str]:
    """CTE ``name``: (<id_col>, dim, w), the non-zero weights of unit hashed TF-IDF vectors.  ``like``:
    an earlier corpus of this function, whose document frequencies are used."""
    p, ref = name, like or name
    ctes = [
        f"{p}_tok AS (SELECT {id_col} AS id, unnest({tokens(text_col)}) AS term FROM {corpus})",
        f"{p}_dim AS (SELECT term, CAST({crc32('term')} % {dims} AS INT) AS dim FROM (SELECT DISTINCT term FROM {p}_tok), crc_table)",
        f"{p}_tf AS (SELECT t.id, d.dim, count(*) AS tf FROM {p}_tok t JOIN {p}_dim d ON t.term = d.term GROUP BY ALL)",
    ]
    if like is None:
        ctes += [f"{p}_idf AS (SELECT dim, ln(((SELECT count(*) FROM {corpus}) + 1) / (count(*) + 1)) AS idf FROM {p}_tf GROUP BY dim)"]
    # a dimension that no document of the corpus has weighs most
    none = f"(SELECT ln(CAST(count(*) + 1 AS DOUBLE)) FROM {'documents' if like else corpus})"
    return ctes + [
        f"{p}_raw AS (SELECT t.id, t.dim, (1 + ln(t.tf)) * coalesce(i.idf, {none}) AS w FROM {p}_tf t LEFT JOIN {ref}_idf i ON t.dim = i.dim)",
        f"{p}_norm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {p}_raw GROUP BY id HAVING sum(w * w) > 0)",
        f"{p} AS (SELECT r.id AS {id_col}, r.dim, r.w / n.norm AS w FROM {p}_raw r JOIN {p}_norm n ON r.id = n.id)",
    ]


def kmeans(name: str, weights: str, id_col: str, k: int, seed: int, iterations: int) -> list[str]:
    """CTE ``name``: (<id_col>, theme, similarity) by spherical k-means over weights (<id_col>, dim, w)."""
    p = name

    def joined(i: int) -> str:
        return (f"{p}_at{i} AS MATERIALIZED (SELECT {id_col}, arg_max(theme, struct_pack(s := s, neg := -theme)) AS theme, max(s) AS s FROM ("
                f"SELECT d.{id_col}, c.theme, round(sum(d.w * c.w), 9) AS s FROM {weights} d JOIN {p}_c{i} c ON d.dim = c.dim GROUP BY ALL) GROUP BY {id_col})")
    ctes = [f"""{p}_seeds AS MATERIALIZED (SELECT {id_col}, CAST(row_number() OVER (ORDER BY md5('{seed}:' || CAST({id_col} AS VARCHAR)), {id_col}) - 1 AS BIGINT) AS theme
  FROM (SELECT DISTINCT {id_col} FROM {weights}) ORDER BY theme LIMIT {k})""",
            f"{p}_c0 AS MATERIALIZED (SELECT s.theme, w.dim, w.w FROM {weights} w JOIN {p}_seeds s ON w.{id_col} = s.{id_col})"]
    for i in range(iterations):
        ctes += [joined(i),
                 f"{p}_sum{i} AS MATERIALIZED (SELECT a.theme, w.dim, sum(w.w) AS w FROM {weights} w JOIN {p}_at{i} a ON w.{id_col} = a.{id_col} GROUP BY ALL)",
                 f"""{p}_c{i + 1} AS MATERIALIZED (SELECT theme, dim, w / sqrt(sum(w * w) OVER (PARTITION BY theme)) AS w FROM {p}_sum{i}
  UNION ALL SELECT theme, dim, w FROM {p}_c{i} WHERE theme NOT IN (SELECT theme FROM {p}_sum{i}))"""]
    return [*ctes, joined(iterations), f"{p} AS (SELECT {id_col}, theme, s AS similarity FROM {p}_at{iterations})"]
