"""The registered queries of the knowledge-base operators and their SQL twins.

Each query runs over its whole tables.  SQL is DuckDB's, over the same page view.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as fn
from .functions import links, stemming
from .operators import changes, graph, logs, rawsweep, search, tags
from .plans import ingest
from .sources import files
from .sources.session import cut
from .sources.views import edges, page_ref, pages, pages_sql, sql_ref, table, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PAGES = pages_sql()
TOKENS = r"""
words AS (
  SELECT page_ref, c, pos, term FROM (
    SELECT page_ref, 'title' AS c, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS term, generate_subscripts(regexp_extract_all(lower(title), '[\p{L}\p{N}]+'), 1) AS pos FROM pages
    UNION ALL SELECT page_ref, 'summary', unnest(regexp_extract_all(lower(summary), '[\p{L}\p{N}]+')), generate_subscripts(regexp_extract_all(lower(summary), '[\p{L}\p{N}]+'), 1) FROM pages
    UNION ALL SELECT page_ref, 'body', unnest(regexp_extract_all(lower(body), '[\p{L}\p{N}]+')), generate_subscripts(regexp_extract_all(lower(body), '[\p{L}\p{N}]+'), 1) FROM pages)),
dls AS (SELECT p.page_ref, count(w.term) AS dl FROM pages p LEFT JOIN words w ON p.page_ref = w.page_ref GROUP BY p.page_ref),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls)
"""
SCORED = r"""
nq AS (SELECT q, count(DISTINCT page_ref) AS nq FROM hits GROUP BY q),
scored AS (
  SELECT h.page_ref, count(DISTINCT h.q) AS matched,
         sum(CAST(round(1e12 * greatest_idf * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * d.dl / avgdl))) AS BIGINT)) / 1e12 AS score
  FROM hits h JOIN (SELECT q, avgdl, CASE WHEN ln((n - nq + 0.5) / (nq + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - nq + 0.5) / (nq + 0.5)) END AS greatest_idf FROM nq, corpus) r ON h.q = r.q
  JOIN dls d ON h.page_ref = d.page_ref GROUP BY h.page_ref)
"""
TF = "sum(CASE c WHEN 'title' THEN 10.0 WHEN 'summary' THEN 5.0 ELSE 1.0 END)"


def hits_sql(terms: list[str]) -> str:
    wanted = ", ".join(f"'{t}'" for t in terms)
    return f"hits AS (SELECT term AS q, page_ref, {TF} AS tf FROM words WHERE term IN ({wanted}) GROUP BY term, page_ref)"


HIT_COLUMNS = "p.page_ref, round(score, 6) AS score, title, kind, source_date, git_date, volatility"


def found_sql(terms: list[str], condition: str, limit: int = 20) -> str:
    return f"WITH {PAGES}, {TOKENS}, {hits_sql(terms)}, {SCORED} SELECT {HIT_COLUMNS} FROM scored s JOIN pages p ON s.page_ref = p.page_ref WHERE {condition} ORDER BY s.score DESC, p.page_ref LIMIT {limit}"


def _search(spark: SparkSession, sf_dir: str, q: search.Query) -> DataFrame:
    return search.search(pages(spark, sf_dir), None, q, texts=texts(spark, sf_dir))


def _hits(df: DataFrame) -> DataFrame:
    return df.select("page_ref", F.round("score", 6).alias("score"), "title", "kind", "source_date", "git_date", "volatility")


# ---- search


@query(found_sql(["the", "and"], "matched = 2 AND superseded_by IS NULL"))
def search_and(spark, sf_dir):
    """S-07, B-01, J-01, O-01."""
    return _hits(_search(spark, sf_dir, search.Query(text="the and")))


@query(found_sql(["the", "die", "que"], "superseded_by IS NULL"))
def search_or(spark, sf_dir):
    """S-08: any of the terms."""
    return _hits(_search(spark, sf_dir, search.Query(text="the die que", match="any")))


@query(f"""WITH {PAGES}, {TOKENS},
pairs AS (SELECT page_ref, c, pos, term, lead(term) OVER (PARTITION BY page_ref, c ORDER BY pos) AS nxt FROM words),
hits AS (SELECT 'of the' AS q, page_ref, {TF} AS tf FROM pairs WHERE term = 'of' AND nxt = 'the' GROUP BY page_ref), {SCORED}
SELECT {HIT_COLUMNS} FROM scored s JOIN pages p ON s.page_ref = p.page_ref WHERE superseded_by IS NULL ORDER BY s.score DESC, p.page_ref LIMIT 20""")
def search_phrase(spark, sf_dir):
    """S-10: adjacent tokens of one column."""
    return _hits(_search(spark, sf_dir, search.Query(text="of-the")))


@query(found_sql(["the"], "superseded_by IS NULL AND list_contains(tags, 'en') AND kind IN ('concept', 'entity') AND volatility IN ('stable', 'evolving') AND source_date >= '2024-02-01' AND source_date <= '2024-11-30'"))
def search_filtered(spark, sf_dir):
    """F-01 to F-08 with text; figures of terms cover all pages."""
    return _hits(_search(spark, sf_dir, search.Query(text="the", tags_all=("en",), kinds=("concept", "entity"), volatility=("stable", "evolving"), since="2024-02-01", until="2024-11-30")))


@query(f"WITH {PAGES}, {TOKENS}, {hits_sql(['the'])}, {SCORED} SELECT p.page_ref, round(score, 6) AS score, array_to_string(tags, ',') AS tags FROM scored s JOIN pages p ON s.page_ref = p.page_ref WHERE superseded_by IS NULL ORDER BY s.score DESC, p.page_ref LIMIT 50")
def search_with_tags(spark, sf_dir):
    """J-03: tags with each hit."""
    return _search(spark, sf_dir, search.Query(text="the", limit=50)).select("page_ref", F.round("score", 6).alias("score"), F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {PAGES}, {TOKENS},
hits AS (SELECT 'title:the' AS q, page_ref, {TF} AS tf FROM words WHERE term = 'the' AND c = 'title' GROUP BY page_ref
  UNION ALL SELECT 'tion*', page_ref, {TF} FROM words WHERE starts_with(term, 'tion') GROUP BY page_ref), {SCORED}
SELECT {HIT_COLUMNS} FROM scored s JOIN pages p ON s.page_ref = p.page_ref WHERE superseded_by IS NULL AND p.page_ref NOT IN (SELECT page_ref FROM words WHERE term = 'of') ORDER BY s.score DESC, p.page_ref LIMIT 20""")
def search_expression(spark, sf_dir):
    """S-09: a word of the title or a prefix anywhere, without the pages that have another word."""
    either = search.Or((search.Phrase("the", columns=("title",)), search.Phrase("tion", prefix=True)))
    return _hits(_search(spark, sf_dir, search.Query(expression=search.Not(either, search.Phrase("of")))))


META = "page_ref, 0.0::DOUBLE AS score, title, kind, source_date, git_date, volatility"


def meta_sql(condition: str, limit: int = 20) -> str:
    return f"WITH {PAGES} SELECT {META} FROM pages WHERE {condition} ORDER BY page_ref LIMIT {limit}"


@query(meta_sql("superseded_by IS NULL AND kind IN ('source') AND volatility IN ('stable')"))
def metadata_only(spark, sf_dir):
    """O-02, F-04, F-07."""
    return _hits(_search(spark, sf_dir, search.Query(kinds=("source",), volatility=("stable",))))


@query(meta_sql("superseded_by IS NULL AND list_contains(tags, 'en') AND list_contains(tags, 'q1')", 100_000_000))
def tags_all(spark, sf_dir):
    """F-02."""
    return _hits(_search(spark, sf_dir, search.Query(tags_all=("en", "q1"), limit=100_000_000)))


@query(meta_sql("superseded_by IS NULL AND (list_contains(tags, 'fr') OR list_contains(tags, 'src3'))", 100_000_000))
def tags_any(spark, sf_dir):
    """F-03."""
    return _hits(_search(spark, sf_dir, search.Query(tags_any=("fr", "src3"), limit=100_000_000)))


@query(meta_sql("superseded_by IS NULL AND source_date <= '2024-03-31'", 100_000_000))
def since_until_source(spark, sf_dir):
    """F-06: an empty date passes the upper bound."""
    return _hits(_search(spark, sf_dir, search.Query(until="2024-03-31", limit=100_000_000)))


@query(meta_sql("superseded_by IS NULL AND git_date >= '2024-07-01' AND git_date <= '2024-09-30'", 100_000_000))
def since_until_git(spark, sf_dir):
    """F-05, F-06: a null date passes neither bound."""
    return _hits(_search(spark, sf_dir, search.Query(since="2024-07-01", until="2024-09-30", date_field="git_date", limit=100_000_000)))


@query(f"WITH {PAGES} SELECT page_ref, title FROM pages WHERE superseded_by IS NULL")
def superseded_exclude(spark, sf_dir):
    """F-01, J-04: pages that no page supersedes, from the edges."""
    view = pages(spark, sf_dir)
    return graph.with_superseded_by(view, edges(view)).where("superseded_by IS NULL").select("page_ref", "title")


# ---- tags and figures


@query(f"WITH {PAGES} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM pages) GROUP BY tag ORDER BY n DESC, tag")
def tag_vocabulary(spark, sf_dir):
    """A-01, O-07."""
    return tags.vocabulary(tags.page_tags(pages(spark, sf_dir)))


@query(f"WITH {PAGES} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM pages) WHERE contains(lower(tag), 'rc1') OR contains(lower(tag), 'e') GROUP BY tag ORDER BY n DESC, tag")
def tag_contains(spark, sf_dir):
    """F-14."""
    return tags.containing(tags.vocabulary(tags.page_tags(pages(spark, sf_dir))), ["RC1", "e"])


@query(f"WITH {PAGES}, w(ord, tag) AS (VALUES (0, 'fr'), (1, 'none'), (2, 'q0')) SELECT CAST(ord AS BIGINT) AS ord, w.tag, count(t.tag) AS n FROM w LEFT JOIN (SELECT unnest(tags) AS tag FROM pages) t ON w.tag = t.tag GROUP BY ord, w.tag")
def tag_exact_count(spark, sf_dir):
    """F-15: in the order asked for, 0 where absent."""
    wanted = spark.createDataFrame([(0, "fr"), (1, "none"), (2, "q0")], "ord long, tag string")
    return tags.exact_counts(tags.vocabulary(tags.page_tags(pages(spark, sf_dir))), wanted)


@query(f"WITH {PAGES} SELECT (SELECT count(*) FROM pages WHERE git_date IS NOT NULL) AS pages, (SELECT count(*) FROM pages) AS on_disk, greatest((SELECT count(*) FROM pages) - (SELECT count(*) FROM pages WHERE git_date IS NOT NULL), 0) AS behind")
def index_status(spark, sf_dir):
    """A-02, A-04: committed pages against those on disk."""
    view = pages(spark, sf_dir).select("page_ref", "git_date")
    return tags.status(view.where("git_date IS NOT NULL"), view)


# ---- discovery


@query(f"""WITH {PAGES}, {TOKENS},
asked AS (SELECT item_id, left(text, 60) AS title, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS terms FROM benchmark),
terms AS (SELECT item_id, unnest(terms) AS q FROM asked),
hits AS (SELECT term AS q, page_ref, {TF} AS tf FROM words WHERE term IN (SELECT q FROM terms) GROUP BY term, page_ref),
rated AS (SELECT q, avgdl, CASE WHEN ln((n - nq + 0.5) / (nq + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - nq + 0.5) / (nq + 0.5)) END AS idf FROM (SELECT q, count(*) AS nq FROM hits GROUP BY q), corpus),
scored AS (SELECT item_id, h.page_ref, sum(CAST(round(1e12 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS BIGINT)) / 1e12 AS score FROM hits h JOIN terms t ON h.q = t.q JOIN rated r ON h.q = r.q JOIN dls d ON h.page_ref = d.page_ref GROUP BY item_id, h.page_ref),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, s.page_ref) AS rank, s.page_ref, score, p.title AS t1 FROM scored s JOIN pages p ON s.page_ref = p.page_ref WHERE superseded_by IS NULL)
SELECT r.item_id AS query_id, CAST(rank AS INTEGER) AS rank, page_ref, round(score, 6) AS score,
       CASE WHEN score >= 15 AND list_has_any(regexp_extract_all(lower(t1), '[a-z0-9]+'), regexp_extract_all(lower(a.title), '[a-z0-9]+')) THEN 'duplicate' WHEN score >= 15 THEN 'refines' WHEN score >= 5 THEN 'related' ELSE 'distinct' END AS hint
FROM ranked r JOIN asked a ON r.item_id = a.item_id WHERE rank <= 200""")
def discover_batch(spark, sf_dir):
    """S-08, J-12, B-03, B-04, O-03: benchmark items as drafts, all in one job."""
    view = pages(spark, sf_dir)
    drafts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 60).alias("title"), fn.discovery_terms("text").alias("terms"))
    return search.discover(view, None, drafts, texts=texts(spark, sf_dir)).withColumn("score", F.round("score", 6))


# ---- scalar functions

SLUG = "regexp_replace(regexp_replace(regexp_replace(lower({x}), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def slug_sql(x: str, longest: int) -> str:
    """Truncation at the last hyphen within the limit, if that leaves eight characters."""
    s = SLUG.format(x=x)
    return f"(SELECT CASE WHEN length(s) <= {longest} THEN s ELSE regexp_replace(CASE WHEN strpos(left(s, {longest}), '-') > 0 AND {longest} - strpos(reverse(left(s, {longest})), '-') >= 8 THEN left(s, {longest} - strpos(reverse(left(s, {longest})), '-')) ELSE left(s, {longest}) END, '-+$', '') END FROM (SELECT {s} AS s))"


@query(f"SELECT p_partkey, {slug_sql('p_name', 12)} AS slug FROM part")
def slug(spark, sf_dir):
    """S-01, S-02 on part names, at a length that truncates."""
    return table(spark, sf_dir, "part").select("p_partkey", fn.slugify("p_name", 12).alias("slug"))


@query(f"WITH {PAGES} SELECT page_ref, 'wiki/' || CASE kind WHEN 'concept' THEN 'concepts' WHEN 'entity' THEN 'entities' WHEN 'source' THEN 'sources' ELSE 'synthesis' END || '/' || {slug_sql('title', 64)} || '.md' AS placed, kind AS kind_of_ref FROM pages")
def placement(spark, sf_dir):
    """S-13, P-09, R-02."""
    view = pages(spark, sf_dir).where(fn.is_page_ref("page_ref"))
    return view.select("page_ref", fn.place("kind", "title").alias("placed"), fn.kind_of("page_ref").alias("kind_of_ref"))


SPELLED = "CASE o_orderkey % 6 WHEN 0 THEN d WHEN 1 THEN d || 'T10:30' WHEN 2 THEN ' ' || d || ' 10:30:59.5Z ' WHEN 3 THEN d || CASE WHEN o_orderkey % 4 = 1 THEN 'T10:30z' ELSE 'T10:30+0200' END WHEN 4 THEN 'summer ' || left(d, 4) ELSE left(d, 4) || '-02-30' END"


@query(f"""WITH s AS (SELECT o_orderkey, {SPELLED} AS spelled FROM (SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS d FROM orders)),
m AS (SELECT *, regexp_extract(trim(spelled), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})(?:[T ]\\d{{2}}:\\d{{2}}(?::\\d{{2}}(?:\\.\\d+)?)?(?:[Zz]|[+-]\\d{{2}}:?\\d{{2}})?)?$', 1) AS day FROM s)
SELECT o_orderkey, CASE WHEN try_cast(nullif(day, '') AS DATE) IS NOT NULL THEN day END AS canonical, coalesce(CASE WHEN try_cast(nullif(day, '') AS DATE) IS NOT NULL THEN day END, spelled) AS tolerant FROM m""")
def canonical_date(spark, sf_dir):
    """S-14 and the tolerant posture, on spellings of order dates."""
    d = table(spark, sf_dir, "orders").withColumn("d", F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"))
    s = d.select("o_orderkey", F.expr(SPELLED).alias("spelled"))
    return s.select("o_orderkey", fn.canonical_date("spelled").alias("canonical"), fn.tolerant_date("spelled").alias("tolerant"))


def encode_sql(x: str) -> str:
    for raw, encoded in fn.ENCODED.items():
        x = f"replace({x}, '{raw}', '{encoded}')"
    return x


@query(f"SELECT page_id, {encode_sql('url')} AS encoded FROM pages")
def percent_encode(spark, sf_dir):
    """S-03 on page addresses."""
    return table(spark, sf_dir, "pages").select("page_id", fn.percent_encode("url").alias("encoded"))


@query(f"WITH {PAGES} SELECT page_ref, '[' || title || '](' || CASE WHEN split_part(supersedes, '/', 2) = split_part(page_ref, '/', 2) THEN '' ELSE '../' || split_part(supersedes, '/', 2) || '/' END || split_part(supersedes, '/', 3) || ')' AS link FROM pages WHERE supersedes IS NOT NULL")
def compose_link(spark, sf_dir):
    """S-04, S-05."""
    view = pages(spark, sf_dir).where("supersedes IS NOT NULL")
    return view.select("page_ref", fn.compose_link("title", "supersedes", F.regexp_extract("page_ref", "^(.*)/[^/]*$", 1)).alias("link"))


@query(f"WITH {PAGES}, e AS (SELECT page_ref, list_concat([CASE WHEN lang IS NOT NULL THEN lang END, source], list_filter(tags, lambda x: x <> lang AND x <> source)) AS merged FROM pages JOIN documents USING (doc_id)) SELECT page_ref, array_to_string(merged, ',') AS merged FROM e")
def merge_ordered(spark, sf_dir):
    """O-05: new values after the existing ones."""
    view = pages(spark, sf_dir).select("doc_id", "page_ref", "tags")
    own = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("own"))
    return view.join(own, "doc_id").select("page_ref", F.array_join(fn.merge_ordered(F.col("own"), F.col("tags")), ",").alias("merged"))


# ---- graph


@query(f"WITH {PAGES} SELECT src, key, dst FROM edges")
def edge_explode(spark, sf_dir):
    """P-04, D-05."""
    return edges(pages(spark, sf_dir)).select("src", "key", "dst")


@query(f"WITH {PAGES} SELECT dst, string_agg(src, ',' ORDER BY src) AS all_sources, min(src) AS first_source FROM (SELECT DISTINCT src, dst FROM edges WHERE key = 'related' AND src <> dst) GROUP BY dst")
def edge_invert(spark, sf_dir):
    """G-01, G-02."""
    return graph.inverted(edges(pages(spark, sf_dir)), "related").withColumn("all_sources", F.array_join("all_sources", ","))


@query(f"""WITH RECURSIVE {PAGES},
step AS (SELECT dst AS src, min(src) AS nxt FROM edges WHERE key = 'supersedes' GROUP BY dst),
walk(seed, cur, hops) AS (SELECT page_ref, page_ref, 0 FROM pages UNION ALL SELECT seed, nxt, hops + 1 FROM walk JOIN step ON cur = step.src)
SELECT seed, max_by(cur, hops) AS active, CAST(max(hops) AS BIGINT) AS hops FROM walk GROUP BY seed""")
def supersession_chain(spark, sf_dir):
    """G-04, G-05: every page's active head."""
    view = pages(spark, sf_dir)
    successors = edges(view).where("key = 'supersedes'").select(F.col("dst").alias("src"), F.col("src").alias("nxt"))
    return graph.chains(view.select(F.col("page_ref").alias("seed")), successors)


@query(f"""WITH RECURSIVE {PAGES},
step AS (SELECT dst AS src, min(src) AS nxt FROM edges WHERE key = 'supersedes' GROUP BY dst),
walk(seed, cur, hops) AS (SELECT page_ref, page_ref, 0 FROM pages UNION ALL SELECT seed, nxt, hops + 1 FROM walk JOIN step ON cur = step.src)
SELECT DISTINCT active AS page_ref FROM (SELECT seed, max_by(cur, hops) AS active FROM walk GROUP BY seed)""")
def currency_rewrite(spark, sf_dir):
    """G-09."""
    view = pages(spark, sf_dir)
    return graph.current(view, supersession_chain(spark, sf_dir))


@query(f"""WITH {PAGES},
ways AS (SELECT src AS a, dst AS b FROM edges WHERE key <> 'source' UNION SELECT dst, src FROM edges WHERE key <> 'source'),
seeds AS (SELECT page_ref AS seed FROM pages),
h1 AS (SELECT DISTINCT seed, b AS page_ref FROM seeds JOIN ways ON seed = a),
h2 AS (SELECT DISTINCT seed, b AS page_ref FROM h1 JOIN ways ON page_ref = a)
SELECT seed, page_ref, min(hop) AS hop FROM (SELECT seed, seed AS page_ref, 0 AS hop FROM seeds UNION ALL SELECT seed, page_ref, 1 FROM h1 UNION ALL SELECT seed, page_ref, 2 FROM h2) GROUP BY seed, page_ref""")
def neighbors_two_hop(spark, sf_dir):
    """G-06, G-07: from every page."""
    view = pages(spark, sf_dir)
    return graph.neighbours(view.select(F.col("page_ref").alias("seed")), edges(view))


@query(f"""WITH RECURSIVE {PAGES},
step AS (SELECT dst AS src, min(src) AS nxt FROM edges WHERE key = 'supersedes' GROUP BY dst),
walk(seed, last, chain) AS (SELECT page_ref, page_ref, CAST([] AS VARCHAR[]) FROM pages UNION ALL SELECT seed, nxt, list_append(chain, nxt) FROM walk JOIN step ON last = step.src)
SELECT seed, max_by(last, len(chain)) AS active, array_to_string(max_by(chain, len(chain)), ' ') AS chain FROM walk GROUP BY seed""")
def supersession_paths(spark, sf_dir):
    """G-04: every page's chain, page by page, without the page itself."""
    view = pages(spark, sf_dir)
    successors = edges(view).where("key = 'supersedes'").select(F.col("dst").alias("src"), F.col("src").alias("nxt"))
    return graph.paths(view.select(F.col("page_ref").alias("seed")), successors).withColumn("chain", F.array_join("chain", " "))


@query(f"WITH {PAGES} SELECT p.page_ref AS seed, p.page_ref, 0 AS hop FROM pages p UNION ALL SELECT DISTINCT dst, src, 1 FROM edges JOIN pages p ON p.page_ref = dst WHERE key = 'refines'")
def question_shape(spark, sf_dir):
    """G-06: what refines each page."""
    view = pages(spark, sf_dir)
    return graph.answers(view.select(F.col("page_ref").alias("seed")), edges(view), "what refines it")


def shapes_sql() -> str:
    """Of each shape's edge the pages it leads to; those of the evidence by two edges."""
    one = "SELECT '{q}' AS question, {a} AS seed, {b} AS page_ref, 1 AS hop FROM edges WHERE key = '{key}'"
    each = [one.format(q=q, a=a, b=b, key=key) for q, (key, way) in graph.QUESTIONS.items() for a, b in (("src", "dst"), ("dst", "src")) if way == "both" or (way == "out") == (a == "src")]
    each += [one.format(q=graph.EVIDENCE, a="src", b="dst", key="source")]
    each += [f"SELECT '{graph.EVIDENCE}', s.src, r.dst, 2 FROM edges s JOIN edges r ON s.dst = r.src WHERE s.key = 'source' AND r.key = 'raw_source'"]
    each += [f"SELECT '{q}', page_ref, page_ref, 0 FROM pages" for q in (*graph.QUESTIONS, graph.EVIDENCE)]
    return f"WITH {PAGES}, found AS ({' UNION ALL '.join(each)}) SELECT question, seed, page_ref, min(hop) AS hop FROM found WHERE seed IN (SELECT page_ref FROM pages) GROUP BY question, seed, page_ref"


@query(shapes_sql())
def question_shapes(spark, sf_dir):
    """G-06: all eleven shapes of a question, of every page."""
    view = pages(spark, sf_dir)
    seeds, own = cut(view.select(F.col("page_ref").alias("seed"))), cut(edges(view))  # met by each shape
    each = [graph.answers(seeds, own, q).select(F.lit(q).alias("question"), "seed", "page_ref", "hop") for q in (*graph.QUESTIONS, graph.EVIDENCE)]
    return reduce(lambda a, b: a.unionByName(b), each)


@query(f"WITH {PAGES} SELECT s.src AS page_ref, s.dst AS stub, r.dst AS raw FROM edges s JOIN edges r ON s.dst = r.src WHERE s.key = 'source' AND r.key = 'raw_source'")
def provenance_path(spark, sf_dir):
    """G-08."""
    return graph.provenance(edges(pages(spark, sf_dir)))


@query(f"""WITH {PAGES}, staged AS (SELECT 'raw/' || source || '/' || CAST(doc_id - doc_id % 5 AS VARCHAR) || '.txt' AS raw, {sql_ref('doc_id')} AS page_ref FROM documents),
stubs AS (SELECT raw, min(s.page_ref) AS stub FROM staged s JOIN edges e ON e.src = s.page_ref AND e.dst = s.raw AND e.key = 'raw_source' WHERE s.page_ref LIKE 'wiki/sources/%' GROUP BY raw)
SELECT raw, min(page_ref) AS page_ref, 'no source stub' AS problem FROM staged WHERE raw NOT IN (SELECT raw FROM stubs) GROUP BY raw
UNION ALL SELECT s.raw, s.page_ref, 'no source edge' FROM staged s JOIN stubs t ON s.raw = t.raw WHERE s.page_ref <> t.stub AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.key = 'source' AND e.src = s.page_ref AND e.dst = t.stub)""")
def evidence_gaps(spark, sf_dir):
    """G-10, I-08: five neighbouring documents staged with one raw file."""
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("raw/"), "source", F.lit("/"), (F.col("doc_id") - F.col("doc_id") % 5).cast("string"), F.lit(".txt"))
    return graph.evidence_gaps(d.select(raw.alias("raw"), page_ref(F.col("doc_id")).alias("page_ref")), edges(pages(spark, sf_dir)))


@query(r"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"#]*)', 1)) AS dest FROM pages) SELECT DISTINCT page_id, dest FROM h WHERE dest <> '' AND dest NOT IN (SELECT url FROM pages)""")
def dangling_links(spark, sf_dir):
    """J-09: addresses in pages that are no page's own."""
    p = table(spark, sf_dir, "pages")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]*)'), F.lit(1))).alias("dst")).where("dst <> ''")
    return graph.dangling(links, p.select(F.col("url").alias("page_ref"))).select("page_id", F.col("dst").alias("dest")).distinct()


# ---- raw sweep

RAW_SQL = f"""{PAGES},
raw AS (SELECT 'raw/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS raw_rel, source, doc_id,
               CASE WHEN doc_id % 11 = 0 THEN '' ELSE strftime(DATE '2024-07-01' + CAST(doc_id % 120 AS INTEGER), '%Y-%m-%d') END AS last_commit_date, doc_id % 19 = 0 AS dirty FROM documents),
lef AS (SELECT * FROM raw WHERE NOT (source = 'src1' AND regexp_matches(CAST(doc_id AS VARCHAR) || '.txt', '^1[^/]*$')) AND NOT (source = 'src2' AND regexp_matches(CAST(doc_id AS VARCHAR) || '.txt', '^[^/]2\\.txt$'))),
met AS (SELECT l.raw_rel, bool_or(dirty) AS dirty, bool_or(p.page_ref IS NOT NULL AND (coalesce(git_date, '') = '' OR (last_commit_date <> '' AND last_commit_date > coalesce(git_date, '')))) AS newer, count(p.page_ref) AS n, string_agg(p.page_ref, ',' ORDER BY p.page_ref) AS back FROM lef l LEFT JOIN pages p ON p.raw_source = l.raw_rel GROUP BY l.raw_rel)"""


def _raw(spark, sf_dir):
    i = F.col("doc_id")
    date = F.when(i % 11 == 0, "").otherwise(F.date_format(F.date_add(F.to_date(F.lit("2024-07-01")), (i % 120).cast("int")), "yyyy-MM-dd"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("raw/"), "source", F.lit("/"), i.cast("string"), F.lit(".txt")).alias("raw_rel"), date.alias("last_commit_date"), (i % 19 == 0).alias("dirty"))


def _sweep(spark, sf_dir):
    view = pages(spark, sf_dir)
    rules = spark.createDataFrame([("raw/src1", "1*"), ("raw/src2", "?2.txt")], "folder string, pattern string")
    return rawsweep.sweep(rawsweep.scoped(_raw(spark, sf_dir)), rules, rawsweep.back_pointers(edges(view)), view.select("page_ref", "git_date"))


@query(f"WITH {RAW_SQL} SELECT raw_rel, last_commit_date FROM raw WHERE raw_rel NOT IN (SELECT raw_source FROM pages WHERE raw_source IS NOT NULL)")
def raw_never_ingested(spark, sf_dir):
    """J-05, J-06."""
    return rawsweep.never_ingested(_raw(spark, sf_dir), rawsweep.back_pointers(edges(pages(spark, sf_dir)))).select("raw_rel", "last_commit_date")


@query(f"WITH {RAW_SQL} SELECT raw_rel, CASE WHEN n = 0 THEN 'never_ingested' WHEN dirty THEN 'dirty' WHEN newer THEN 'changed' END AS reason, coalesce(back, '') AS back_pointers FROM met WHERE n = 0 OR dirty OR newer")
def raw_sweep(spark, sf_dir):
    """I-10, J-08, F-09."""
    return _sweep(spark, sf_dir).withColumn("back_pointers", F.array_join("back_pointers", ","))


@query(f"WITH {RAW_SQL} SELECT raw_rel FROM met WHERE n > 0 AND NOT dirty AND newer")
def raw_changed(spark, sf_dir):
    """J-07, F-12."""
    return _sweep(spark, sf_dir).where("reason = 'changed'").select("raw_rel")


# ---- logs and conversations


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), F.col("user_id").cast("string").alias("prompt_id"), "ts")


@query("SELECT coalesce(nullif(event_type, ''), '?') AS tool, count(*) AS calls, min(event_id) AS first_seq FROM events GROUP BY 1 ORDER BY calls DESC, first_seq")
def tool_histogram(spark, sf_dir):
    """A-05."""
    return logs.tool_histogram(_log(spark, sf_dir))


@query("SELECT count(*) AS calls, count(DISTINCT user_id) AS prompts, round(count(*) / count(DISTINCT user_id), 1) AS per_prompt FROM events")
def calls_per_prompt(spark, sf_dir):
    """A-06, A-07."""
    return logs.calls_per_prompt(_log(spark, sf_dir))


@query("SELECT conv_id, turn, role, trim(text) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
def turns_filtered(spark, sf_dir):
    """F-13."""
    return logs.spoken(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


@query("""WITH t AS (SELECT conv_id, turn, '## ' || CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || chr(10) || chr(10) || trim(text) || chr(10) AS s FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '')
SELECT conv_id, count(*) AS turns, '# Session ' || CAST(conv_id AS VARCHAR) || chr(10) || chr(10) || string_agg(s, chr(10) ORDER BY turn, s) AS markdown FROM t GROUP BY conv_id HAVING count(*) >= 2""")
def render_conversation(spark, sf_dir):
    """T-03."""
    return logs.rendered(table(spark, sf_dir, "conversations"))


DEBOUNCED = """WITH a AS (SELECT user_id AS rel, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '{gap} seconds' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY rel ORDER BY ts, event_id) AS run FROM a)
SELECT rel, min(ts) AS started, max(ts) AS last_event, count(*) AS events FROM b GROUP BY rel, run"""


@query(DEBOUNCED.format(gap=1800))
def debounce_sessions(spark, sf_dir):
    """W-02 with a gap of half an hour."""
    return logs.debounced(table(spark, sf_dir, "events").select(F.col("user_id").alias("rel"), "ts", F.col("event_id").alias("seq")), 1800)


@query(f"WITH s AS ({DEBOUNCED.format(gap=30)}) SELECT s.rel, last_event FROM s WHERE rel IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def settled_eligible(spark, sf_dir):
    """W-04, J-11: settled keys that are eligible, here customers in credit."""
    settled = logs.debounced(table(spark, sf_dir, "events").select(F.col("user_id").alias("rel"), "ts", F.col("event_id").alias("seq")), 30)
    eligible = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("rel"))
    return settled.join(eligible, "rel", "left_semi").select("rel", "last_event")


# ---- change feeds


@query("SELECT 'c' || CAST(o_custkey AS VARCHAR) AS path, strftime(max(o_orderdate), '%Y-%m-%d') AS git_date FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY o_custkey")
def last_commit_per_path(spark, sf_dir):
    """A-08: orders as commits of their customer's path, every tenth a merge."""
    o = table(spark, sf_dir, "orders")
    parents = F.when(F.col("o_orderkey") % 10 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return changes.last_commits(o.select(F.col("o_orderkey").alias("sha"), parents.alias("parents"), F.col("o_orderdate").cast("timestamp").alias("author_ts"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path")))


BEFORE = "before AS (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0)"
AFTER = "aft AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 9 <> 0)"


def _snapshots(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    after = d.where("doc_id % 9 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return d.where("doc_id % 7 <> 0"), after


@query(f"WITH {BEFORE}, {AFTER} SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'inserted' WHEN a.doc_id IS NULL THEN 'removed' ELSE 'updated' END AS change FROM before b FULL JOIN aft a ON b.doc_id = a.doc_id WHERE b.text IS DISTINCT FROM a.text")
def change_classify(spark, sf_dir):
    """K-06, K-02: two snapshots of the documents."""
    return changes.classified(*_snapshots(spark, sf_dir), key="doc_id")


@query(f"WITH {BEFORE}, {AFTER}, c AS (SELECT CASE WHEN b.doc_id IS NULL THEN 'i' WHEN a.doc_id IS NULL THEN 'r' ELSE 'u' END AS change FROM before b FULL JOIN aft a ON b.doc_id = a.doc_id WHERE b.text IS DISTINCT FROM a.text) SELECT count(*) FILTER (change = 'i') AS inserted, count(*) FILTER (change = 'u') AS updated, count(*) FILTER (change = 'r') AS removed, (SELECT count(*) FROM aft) AS pages FROM c")
def apply_stats(spark, sf_dir):
    """A-03."""
    b, a = _snapshots(spark, sf_dir)
    return changes.apply_stats(b.withColumnRenamed("doc_id", "page_ref"), a.withColumnRenamed("doc_id", "page_ref"))


@query(f"WITH {AFTER} SELECT doc_id, md5(text) AS digest FROM aft")
def delta_equals_rebuild(spark, sf_dir):
    """W-07, K-03, K-04: the old snapshot with its delta applied is the new one."""
    b, a = _snapshots(spark, sf_dir)
    changed = changes.classified(b, a, key="doc_id")
    delta = changed.join(a, "doc_id", "left").select("doc_id", "text", (F.col("change") == "removed").alias("deleted"))
    return changes.apply_delta(b, delta, key="doc_id").select("doc_id", F.md5("text").alias("digest"))


# ---- markdown: pages are written out as text and read back


def _markdown(view: DataFrame) -> DataFrame:
    """(doc_id, page_ref, text): the page view as markdown: frontmatter with all typed edges, a
    link in a code block, a link, and the whole text."""
    folder = F.regexp_extract("page_ref", "^(.*)/[^/]*$", 1)
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    listed = edges(view).groupBy("src", "key").agg(F.sort_array(F.collect_list("dst")).alias("dsts")).groupBy(F.col("src").alias("page_ref")).agg(F.map_from_entries(F.collect_list(F.struct("key", "dsts"))).alias("e"))
    met = view.join(listed, "page_ref", "left")

    def linked(key: str):
        each = F.transform(F.col("e")[key], lambda d: F.concat(F.lit('"'), fn.compose_link(F.lit("t"), d, folder), F.lit('"')))
        if key == "raw_source":
            return F.concat(F.lit("raw_source: "), F.get(each, F.lit(0)))
        return F.concat(F.lit(f"{key}:\n  - "), F.array_join(each, "\n  - "))

    lines = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("title: "), quoted("title")),
        F.concat(F.lit("summary: "), quoted("summary")),
        F.concat(F.lit("tags: "), F.to_json("tags")),
        F.when(F.col("source_date") != "", F.concat(F.lit("source_date: "), "source_date")),
        F.concat(F.lit("volatility: "), "volatility"),
        *[linked(k) for k in graph.EDGE_KEYS],
        F.lit("---"),
        F.lit("```\n[no link](none.md)\n```"),
        F.concat(F.lit("See "), fn.compose_link(F.lit("next"), page_ref(F.col("doc_id") + 1), folder), F.lit(".\n")),
        F.col("body"),
    )
    return met.select("doc_id", "page_ref", lines.alias("text"))


@query(f"WITH {PAGES} SELECT page_ref, kind, title, summary, array_to_string(tags, ',') AS tags, source_date, volatility, md5(body) AS body FROM pages")
def page_records(spark, sf_dir):
    """P-01 to P-03: records parsed from markdown, with their whole bodies."""
    parsed = files.records(_markdown(pages(spark, sf_dir)).drop("doc_id"))
    own = F.md5(F.regexp_replace("body", r"(?s)\A```\n.*?\n```\n[^\n]*\n\n", ""))
    return parsed.select("page_ref", "kind", "title", "summary", F.array_join("tags", ",").alias("tags"), "source_date", "volatility", own.alias("body"))


@query(f"WITH {PAGES} SELECT src, key, dst FROM edges")
def record_edges(spark, sf_dir):
    """P-04, P-05, P-07, P-08: typed edges of every key from links in the frontmatter."""
    return files.record_edges(files.records(_markdown(pages(spark, sf_dir)).drop("doc_id"))).select("src", "key", "dst")


@query(f"""WITH {PAGES}, own AS (SELECT src, count(DISTINCT key) FILTER (key <> 'raw_source') + count(*) AS lines FROM edges WHERE key <> 'raw_source' GROUP BY src)
SELECT page_ref, {sql_ref('doc_id + 1')} AS target, CAST(9 + (source_date <> '')::INT + (raw_source IS NOT NULL)::INT + coalesce(lines, 0) AS INTEGER) AS line, CAST(coalesce(lines - (SELECT count(DISTINCT key) FROM edges e WHERE e.src = page_ref AND key <> 'raw_source'), 0) + (raw_source IS NOT NULL)::INT + 1 AS BIGINT) AS links FROM pages LEFT JOIN own ON src = page_ref""")
def link_scan(spark, sf_dir):
    """P-05, P-08, S-19: the links of whole pages; of bodies the last, resolved, with its line;
    those in code don't count."""
    scanned = _markdown(pages(spark, sf_dir)).select("page_ref", F.explode(links.links_of("text")).alias("l"))
    folder = F.regexp_extract("page_ref", "^(.*)/[^/]*$", 1)
    last = F.max_by(F.struct(fn.resolve_path(F.col("l.path"), folder).alias("target"), F.col("l.line").alias("line")), "l.start")
    return scanned.groupBy("page_ref").agg(last.alias("x"), F.count("*").alias("links")).select("page_ref", "x.target", F.col("x.line").cast("int").alias("line"), "links")


@query(f"""WITH {PAGES}, m AS (SELECT min(page_ref) AS old FROM pages WHERE doc_id % 4 = 1),
b AS (SELECT page_ref, CASE WHEN {sql_ref('doc_id + 1')} = old THEN 'See [next](../moved/new%20%281%29.md).' ELSE 'See [next](../' || substr({sql_ref('doc_id + 1')}, 6) || ').' END AS see, body, old FROM pages, m)
SELECT CASE WHEN page_ref = old THEN 'wiki/moved/new (1).md' ELSE page_ref END AS page_ref, see, md5(body) AS body FROM b""")
def move_retarget(spark, sf_dir):
    """G-11, G-12: a page moves, and links at it follow; the rest of each text stays."""
    md = _markdown(pages(spark, sf_dir))
    old = md.where("doc_id % 4 = 1").agg(F.min("page_ref")).first()[0]
    moved = links.move(md.select("page_ref", "text"), old, "wiki/moved/new (1).md").withColumn("body", fn.body("text"))
    head = r"(?s)\A```\n\[no link\]\(none.md\)\n```\n([^\n]*)\n\n"
    return moved.select("page_ref", F.regexp_extract("body", head, 1).alias("see"), F.md5(F.regexp_replace("body", head, "")).alias("body"))


@query()
def search_stemmed(spark, sf_dir):
    """S-11, B-02: the stemmed analyzer, with snippets of the hits."""
    view = pages(spark, sf_dir)
    hits = search.search(view, None, search.Query(text="things thing", match="any"), stemming.stemmed_tokens, texts(spark, sf_dir))
    met = hits.select("page_ref", "score").join(view.select("page_ref", "body"), "page_ref")
    return stemming.with_snippets(met, ["things"]).select("page_ref", "score", "snippet")


PLAN_ROWS = """SELECT doc_id AS plan_id, CASE doc_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'create' ELSE 'drop' END AS op, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'T ' || CAST(doc_id AS VARCHAR) END AS title, CASE WHEN doc_id % 6 < 3 THEN 'concept' WHEN doc_id % 6 = 3 THEN 'thing' ELSE '' END AS kind, CASE WHEN doc_id % 7 = 0 THEN '2024-02-30' ELSE '2024-02-03T10:00z' END AS source_date FROM documents"""


@query(f"""WITH p AS ({PLAN_ROWS}),
e AS (SELECT plan_id, CASE WHEN op = 'drop' THEN ['page 0: op that is neither create nor update'] ELSE list_filter([
  CASE WHEN op = 'create' AND kind = 'thing' THEN 'page 0: new page of an unknown kind' END,
  CASE WHEN op = 'create' AND kind = '' THEN 'page 0: new page without a kind' END,
  CASE WHEN op = 'update' AND kind <> '' THEN 'page 0: update that gives a kind' END,
  CASE WHEN op = 'update' THEN 'page 0: update that names no page' END,
  CASE WHEN title = '' THEN 'page 0: page without a title' END,
  CASE WHEN source_date = '2024-02-30' THEN 'page 0: source_date that is no date' END], lambda x: x IS NOT NULL) END AS errors FROM p)
SELECT plan_id, array_to_string(list_sort(errors), '; ') AS errors FROM e WHERE len(errors) > 0""")
def plan_errors(spark, sf_dir):
    """I-04, R-15: a plan in JSON for each document, with what is wrong with its page by itself."""
    sql = PLAN_ROWS.replace("VARCHAR", "STRING").removesuffix(" FROM documents").removeprefix("SELECT ")
    p = table(spark, sf_dir, "documents").select(F.expr(f"named_struct({_named_struct(sql)})").alias("p")).select("p.*")
    page = F.struct("op", "title", "kind", F.lit("body").alias("body"), F.struct("source_date").alias("frontmatter"))
    plans = p.select("plan_id", F.to_json(F.struct(F.lit("t").alias("title"), F.array(page).alias("pages"))).alias("value"))
    each = ingest.planned_pages(ingest.decode(plans)).select("plan_id", F.array_sort(ingest.shape_errors()).alias("e")).where("size(e) > 0")
    return each.select("plan_id", F.array_join("e", "; ").alias("errors"))


@query(f"""WITH {PAGES},
p AS (SELECT doc_id AS plan_id, CASE doc_id % 3 WHEN 0 THEN 'wiki/concepts/t-' || CAST(doc_id AS VARCHAR) || '.md' WHEN 1 THEN {sql_ref('doc_id')} ELSE 'wiki/concepts/none-' || CAST(doc_id AS VARCHAR) || '.md' END AS target, doc_id % 3 = 2 AS missing, {sql_ref('doc_id + 1')} AS edge, doc_id % 4 = 0 AS has_raw FROM documents),
e AS (SELECT plan_id, list_filter([
  CASE WHEN has_raw THEN 'no page of the plan is the source of its raw file' END,
  CASE WHEN edge NOT IN (SELECT page_ref FROM pages) THEN 'page 0: edge to no page: ' || edge END,
  CASE WHEN missing THEN 'page 0: there is no page: ' || target END], lambda x: x IS NOT NULL) AS errors FROM p)
SELECT plan_id, array_to_string(errors, '; ') AS errors FROM e WHERE len(errors) > 0""")
def plan_problems(spark, sf_dir):
    """I-05, J-09, A-10, G-10: plans that need other pages: targets, edges and evidence."""
    i = F.col("doc_id")
    number = i.cast("string")
    page = F.struct(
        F.when(i % 3 == 0, "create").otherwise("update").alias("op"),
        F.concat(F.lit("T "), number).alias("title"),
        F.when(i % 3 == 0, "concept").alias("kind"),
        F.when(i % 3 == 1, page_ref(i)).when(i % 3 == 2, F.concat(F.lit("wiki/concepts/none-"), number, F.lit(".md"))).alias("page_ref"),
        F.lit("b").alias("body"),
        F.struct(F.array(page_ref(i + 1)).alias("related")).alias("edges"),
    )
    plan = F.struct(F.lit("t").alias("title"), F.when(i % 4 == 0, "raw/x.txt").alias("raw"), F.array(page).alias("pages"))
    plans = table(spark, sf_dir, "documents").select(i.alias("plan_id"), F.to_json(plan).alias("value"))
    return ingest.errors(ingest.decode(plans), pages(spark, sf_dir).select("page_ref", "title"))


def _named_struct(select: str) -> str:
    """A select list's ``x AS n, ...`` as ``'n', x, ...``."""
    names = ("plan_id", "op", "title", "kind", "source_date")
    out, rest = [], select
    for n in names:
        x, _, rest = rest.partition(f" AS {n}")
        out.append(f"'{n}', {x.removeprefix(', ')}")
    return ", ".join(out)
