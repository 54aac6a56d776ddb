"""The operators applied to the tables, each with DuckDB SQL that gives the same rows by a path of its own where
there is one (greedy numerals, ASOF joins, recursive walks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import labels
from ..functions import scalars as sc
from ..operators import relational as rel

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- page labels

_GREEDY = """WITH RECURSIVE numerals(v, s) AS (VALUES (1000,'m'),(900,'cm'),(500,'d'),(400,'cd'),(100,'c'),(90,'xc'),(50,'l'),(40,'xl'),(10,'x'),(9,'ix'),(5,'v'),(4,'iv'),(1,'i')),
  step(n, left_, s) AS (SELECT p_partkey, p_partkey, '' FROM part WHERE p_partkey BETWEEN 1 AND 65536
    UNION ALL SELECT n, left_ - (SELECT max(v) FROM numerals WHERE v <= left_), s || (SELECT arg_max(numerals.s, v) FROM numerals WHERE v <= left_) FROM step WHERE left_ > 0)
"""


@query(_GREEDY + "SELECT n AS p_partkey, s AS roman FROM step WHERE left_ = 0 UNION ALL SELECT p_partkey, p_partkey::VARCHAR FROM part WHERE p_partkey NOT BETWEEN 1 AND 65536")
def label_roman(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", labels.roman(F.col("p_partkey")).alias("roman"))


@query("SELECT p_partkey, CASE WHEN p_partkey BETWEEN 1 AND 1664 THEN repeat(chr((97 + (p_partkey - 1) % 26)::INT), ((p_partkey - 1) // 26 + 1)::BIGINT) ELSE p_partkey::VARCHAR END AS alpha FROM part")
def label_alpha(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", labels.alpha(F.col("p_partkey")).alias("alpha"))


def _pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.col("source").alias("doc"), F.floor(F.col("doc_id") / 20).cast("long").alias("page"))
    starts = docs.where("doc_id % 140 < 20").select(F.col("source").alias("doc"), F.floor(F.col("doc_id") / 20).cast("long").alias("page"), F.element_at(F.array(*[F.lit(s) for s in ("D", "r", "R", "a", "A", "-")]), (F.floor(F.col("doc_id") / 140) % 6 + 1).cast("int")).alias("style"), F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string"), F.lit("-")).alias("prefix"), F.floor(F.col("doc_id") / 20).cast("long").alias("first"))
    return pages, starts


_RANGES = """WITH pages AS (SELECT source AS doc, doc_id // 20 AS page FROM documents),
  starts AS (SELECT source AS doc, doc_id // 20 AS page, (['D','r','R','a','A','-'])[(doc_id // 140) % 6 + 1] AS style, 'p' || (doc_id % 3) || '-' AS prefix, doc_id // 20 AS first FROM documents WHERE doc_id % 140 < 20)
"""


@query(_RANGES + "SELECT p.doc, p.page, s.style, s.prefix, s.first FROM pages p ASOF LEFT JOIN starts s ON p.doc = s.doc AND p.page >= s.page")
def label_ranges_asof(spark, sf_dir):
    pages, starts = _pages(spark, sf_dir)
    return rel.as_of(pages, starts, ["doc"], "page", ["style", "prefix", "first"])


def _labelled(spark, sf_dir):
    pages, starts = _pages(spark, sf_dir)
    joined = rel.as_of(pages, starts, ["doc"], "page", ["style", "prefix", "first"])
    text = F.when(F.col("first").isNull(), (F.col("page") + 1).cast("string")).otherwise(labels.label(F.col("style"), F.col("prefix"), F.col("page") - F.col("first") + 1))
    return joined.select("doc", "page", text.alias("label"))


_LABELS = _RANGES + """, n AS (SELECT p.doc, p.page, s.style, s.prefix, s.first, p.page - s.first + 1 AS k FROM pages p ASOF LEFT JOIN starts s ON p.doc = s.doc AND p.page >= s.page),
  roman AS (SELECT *, (['','m','mm'])[k // 1000 + 1] || (['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'])[k // 100 % 10 + 1] || (['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'])[k // 10 % 10 + 1] || (['','i','ii','iii','iv','v','vi','vii','viii','ix'])[k % 10 + 1] AS r FROM n),
  labelled AS (SELECT doc, page, CASE WHEN first IS NULL THEN (page + 1)::VARCHAR ELSE prefix || CASE style WHEN 'D' THEN k::VARCHAR WHEN 'r' THEN r WHEN 'R' THEN upper(r) WHEN 'a' THEN repeat(chr((97 + (k - 1) % 26)::INT), ((k - 1) // 26 + 1)::BIGINT) WHEN 'A' THEN repeat(chr((65 + (k - 1) % 26)::INT), ((k - 1) // 26 + 1)::BIGINT) ELSE '' END END AS label FROM roman)
"""


@query(_LABELS + "SELECT * FROM labelled")
def label_format(spark, sf_dir):
    return _labelled(spark, sf_dir)


@query(_LABELS + "SELECT * FROM labelled WHERE lower(label) = 'p1-iii'")
def pages_with_label(spark, sf_dir):
    return _labelled(spark, sf_dir).where(F.col("label").rlike(r"(?iu)\AP1-III\z"))


# ---- geometry

_PART = "p_partkey"


@query("SELECT p_partkey, (((((p_partkey * 37 - 5000) % 360 + 360) % 360 + 45) // 90) * 90 % 360)::INT AS turn FROM part")
def rotate_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select(_PART, geo.rotation(F.col(_PART) * 37 - 5000).alias("turn"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 IN (1, 3) THEN 792.0 ELSE p_size + 100.0 END::DOUBLE AS width, CASE WHEN p_partkey % 4 IN (1, 3) THEN p_size + 100.0 ELSE 792.0 END::DOUBLE AS height FROM part")
def display_size(spark, sf_dir):
    w, h = geo.display_size(F.col("p_size") + F.lit(100.0), F.lit(792.0), F.col(_PART) % 4 * 90)
    return table(spark, sf_dir, "part").select(_PART, w.alias("width"), h.alias("height"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_tax * 1000 AS y, l_linenumber % 4 * 90 AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE t WHEN 90 THEN y WHEN 180 THEN 612 - x WHEN 270 THEN 792 - y ELSE x END, 6) AS px, round(CASE t WHEN 90 THEN x WHEN 180 THEN y WHEN 270 THEN 612 - x ELSE 792 - y END, 6) AS py FROM p""")
def to_top_left(spark, sf_dir):
    x, y = geo.to_top_left(F.col("l_quantity"), F.col("l_tax") * 1000, F.lit(612.0), F.lit(792.0), F.col("l_linenumber") % 4 * 90)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, [0.0, 0.0, 30.0, 40.0] AS m, [l_quantity, l_tax * 100, l_quantity + 10, l_tax * 100 + 20] AS c FROM lineitem),
 i AS (SELECT *, greatest(m[1], c[1]) AS a, greatest(m[2], c[2]) AS b2, least(m[3], c[3]) AS c2, least(m[4], c[4]) AS d FROM b)
SELECT l_orderkey, l_linenumber, round(if(a < c2 AND b2 < d, a, m[1])::DOUBLE, 6) AS x0, round(if(a < c2 AND b2 < d, b2, m[2])::DOUBLE, 6) AS y0, round(if(a < c2 AND b2 < d, c2, m[3])::DOUBLE, 6) AS x1, round(if(a < c2 AND b2 < d, d, m[4])::DOUBLE, 6) AS y1 FROM i""")
def effective_box(spark, sf_dir):
    q, t = F.col("l_quantity"), F.col("l_tax") * 100
    box = geo.effective_box((F.lit(0.0), F.lit(0.0), F.lit(30.0), F.lit(40.0)), (q, t, q + 10, t + 20))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(v, 6).alias(n) for v, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, greatest(floor(l_quantity * 2.5), 0) AS a, greatest(floor(l_tax * 250), 0) AS b, least(ceil((l_quantity + 7) * 2.5), 100) AS c, least(ceil((l_tax * 100 + 9) * 2.5), 200) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, if(a < c AND b < d, a, 0)::BIGINT AS x0, if(a < c AND b < d, b, 0)::BIGINT AS y0, if(a < c AND b < d, c, 0)::BIGINT AS x1, if(a < c AND b < d, d, 0)::BIGINT AS y1 FROM r""")
def scale_rect(spark, sf_dir):
    q, t = F.col("l_quantity"), F.col("l_tax")
    box = geo.scale_rect(q, t * 100, q + 7, t * 100 + 9, F.lit(2.5), F.lit(100), F.lit(200))
    box = (*box[:1], *geo.scale_rect(q, t * F.lit(100.0), q + 7, t * 100 + 9, F.lit(2.5), F.lit(100), F.lit(200))[1:])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[v.alias(n) for v, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])


@query("SELECT l_orderkey, l_linenumber, least(greatest(floor(l_quantity * 1.75), 0), 60)::BIGINT AS px FROM lineitem")
def scale_point(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geo.scale_point(F.col("l_quantity"), F.lit(1.75), F.lit(60)).alias("px"))


@query("SELECT p_partkey, least(greatest(p_size * 9, 1) / 72.0, 10.0)::DOUBLE AS scale, ceil((p_retailprice::FLOAT * least(greatest(p_size * 9, 1) / 72.0::DOUBLE, 10.0)::FLOAT)::DOUBLE - 0.001)::BIGINT AS pixels FROM part")
def extent(spark, sf_dir):
    scale = geo.scale_of(F.col("p_size") * 9)
    return table(spark, sf_dir, "part").select(_PART, scale.alias("scale"), geo.extent(F.col("p_retailprice"), scale).alias("pixels"))


@query("SELECT p_partkey, round(least(1000.0::DOUBLE / (p_size + 10), 800.0::DOUBLE / (p_retailprice + 10)), 9) AS scale FROM part")
def fit_scale(spark, sf_dir):
    return table(spark, sf_dir, "part").select(_PART, F.round(geo.fit_scale(F.col("p_size") + 10, F.col("p_retailprice") + 10, 1000.0, 800.0), 9).alias("scale"))


@query("SELECT l_orderkey, l_linenumber, least(l_quantity, l_tax, l_discount, 5.0) AS x0, least(l_discount, l_quantity, 7.0, l_tax) AS y0, greatest(l_quantity, l_tax, l_discount, 5.0) AS x1, greatest(l_discount, l_quantity, 7.0, l_tax) AS y1 FROM lineitem")
def quad_bbox(spark, sf_dir):
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    box = geo.bounds([q, t, d, F.lit(5.0)], [d, q, F.lit(7.0), t])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[v.alias(n) for v, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * 2 + l_tax * 0.5 + 10, 6) AS x, round(l_quantity * -1 + l_tax * 3 - 4, 6) AS y FROM lineitem")
def matrix_apply(spark, sf_dir):
    m = tuple(F.lit(v) for v in (2.0, -1.0, 0.5, 3.0, 10.0, -4.0))
    x, y = geo.apply_matrix(m, F.col("l_quantity"), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS x, round(l_tax, 6) AS y FROM lineitem WHERE l_quantity * 3 - l_discount <> 0")
def matrix_invert(spark, sf_dir):
    m = (F.col("l_quantity"), F.col("l_discount"), F.lit(1.0), F.lit(3.0), F.lit(10.0), F.lit(-4.0))
    x, y = geo.apply_matrix(geo.invert(m), *geo.apply_matrix(m, F.col("l_quantity"), F.col("l_tax")))
    return table(spark, sf_dir, "lineitem").where(F.col("l_quantity") * 3 - F.col("l_discount") != 0).select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("SELECT p_partkey, ((2 * (p_size + 1) + 1.5 * 4))::DOUBLE AS a, (2 * p_size + 1.5 * 5)::DOUBLE AS b FROM part")
def matrix_multiply(spark, sf_dir):
    m = tuple(F.lit(v) for v in (2.0, 1.5, 0.5, 3.0, 1.0, 1.0))
    n = (F.col("p_size") + 1, F.col("p_size"), F.lit(4.0), F.lit(5.0), F.lit(0.0), F.lit(0.0))
    out = geo.multiply(m, n)
    return table(spark, sf_dir, "part").select(_PART, out[0].alias("a"), out[1].alias("b"))


# ---- strings and links

@query("SELECT doc_id, trim(regexp_replace(text, '[\\p{C}\\p{Zl}\\p{Zp}\\x{FFFD}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]', '', 'g')) AS clean FROM documents")
def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sc.sanitized(F.col("text")).alias("clean"))


@query("SELECT doc_id, replace(replace(replace('ﬁ' || text || 'ﬄ ﬆ', 'ﬁ', 'fi'), 'ﬄ', 'ffl'), 'ﬆ', 'st') AS plain FROM documents")
def ligature_expand(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sc.without_ligatures(F.concat(F.lit("ﬁ"), "text", F.lit("ﬄ ﬆ"))).alias("plain"))


@query("SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AS has_scheme FROM pages")
def uri_scheme(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", sc.has_scheme(F.col("url")).alias("has_scheme"))


_LINKS = "WITH l AS (SELECT page_id, unnest(h) AS href, unnest(range(len(h))) AS ord FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages)) "


def _links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("ord", "href"))


@query(_LINKS + "SELECT page_id, ord::INT AS ord, href FROM l")
def page_links(spark, sf_dir):
    return _links(spark, sf_dir)


@query(_LINKS + "SELECT page_id, count(*) AS n, count(*) FILTER (href LIKE '/%') AS inside FROM l GROUP BY page_id")
def links_external(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(~sc.has_scheme(F.col("href")) & F.col("href").startswith("/")).alias("inside"))


@query(_LINKS + "SELECT page_id, ord::INT AS ord, href FROM (SELECT * FROM l WHERE len(href) > 4) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ord) <= 3")
def links_capped(spark, sf_dir):
    return rel.capped(_links(spark, sf_dir).where(F.length("href") > 4), ["page_id"], ["ord"], 3)


_FRAGMENT = "'page=' || (page_id % 50) || '&zoom=' || (page_id % 7) || ',' || (page_id % 11) || ',x'"


@query(f"SELECT page_id, try_cast(split_part(split_part(f, 'page=', 2), '&', 1) AS BIGINT) - 1 AS page, try_cast(split_part(split_part(f, 'zoom=', 2), ',', 2) AS DOUBLE) AS x, try_cast(split_part(split_part(f, 'zoom=', 2), ',', 3) AS DOUBLE) AS y FROM (SELECT page_id, {_FRAGMENT} AS f FROM pages)")
def uri_fragment(spark, sf_dir):
    i = F.col("page_id")
    text = F.concat(F.lit("page="), (i % 50).cast("string"), F.lit("&zoom="), (i % 7).cast("string"), F.lit(","), (i % 11).cast("string"), F.lit(",x"))
    args = F.str_to_map(text, F.lit("&"), F.lit("="))
    zoom = F.split(F.try_element_at(args, F.lit("zoom")), ",")
    return table(spark, sf_dir, "pages").select("page_id", (F.try_element_at(args, F.lit("page")).try_cast("long") - 1).alias("page"), F.try_element_at(zoom, F.lit(2)).try_cast("double").alias("x"), F.try_element_at(zoom, F.lit(3)).try_cast("double").alias("y"))


@query("SELECT c_custkey, coalesce(n.n_name, r.r_name) AS target FROM customer LEFT JOIN nation n ON n_nationkey = c_nationkey AND n_nationkey < 12 LEFT JOIN region r ON r_regionkey = c_nationkey % 7")
def named_dest_join(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n.where("n_nationkey < 12"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("r_regionkey") == F.col("c_nationkey") % 7, "left").select("c_custkey", F.coalesce("n_name", "r_name").alias("target"))


# ---- merges

@query("SELECT user_id, event_id, event_type FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'")
def xref_first_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("age"))
    return rel.first_wins(e, ["user_id"], [F.col("age"), -F.col("event_id")], F.col("event_type") == "error").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_id % 997 = 0) GROUP BY ALL")
def repair_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    shadowed = e.where("event_id % 997 = 0").select("user_id").distinct()
    return rel.last_wins(e.join(shadowed, "user_id", "left_anti").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], [F.col("event_id")])


@query("SELECT user_id, first(value ORDER BY event_id) FILTER (event_type = 'click') AS click, first(value ORDER BY event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def trailer_merge(spark, sf_dir):
    of = lambda kind: F.min_by(F.when(F.col("event_type") == kind, F.col("value")), F.when(F.col("event_type") == kind, F.col("event_id"))).alias(kind)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(of("click"), of("view"))


@query("WITH RECURSIVE hop AS (SELECT conv_id, turn, 0 AS hops FROM conversations WHERE turn = (SELECT min(turn) FROM conversations) UNION ALL SELECT c.conv_id, c.turn, hops + 1 FROM hop JOIN conversations c ON c.conv_id = hop.conv_id AND c.turn = hop.turn + 1 WHERE hops < 64) SELECT conv_id, max(turn) AS last_turn, max(hops)::INT AS hops FROM hop GROUP BY conv_id")
def ref_resolve_chain(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    least = c.agg(F.min("turn").alias("start"))
    window = Window.partitionBy("conv_id").orderBy("turn")
    turns = c.select("conv_id", "turn").distinct().crossJoin(F.broadcast(least))  # one row
    run = turns.withColumn("k", F.row_number().over(window) - 1).where((F.col("turn") == F.col("start") + F.col("k")) & (F.col("k") <= 64))
    return run.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max("k").cast("int").alias("hops"))


# ---- trees

_TREE = """WITH RECURSIVE t AS (
  SELECT r_regionkey AS id, 0 AS depth, lpad(r_regionkey::VARCHAR, 9, '0') AS path, r_name AS inherited, r_regionkey AS key FROM region
  UNION ALL (SELECT n_nationkey, 1, path || lpad(n_nationkey::VARCHAR, 9, '0'), if(n_nationkey % 3 = 0, n_name, inherited), n_nationkey FROM t JOIN nation ON depth = 0 AND n_regionkey = key
  UNION ALL SELECT c_custkey, 2, path || lpad(c_custkey::VARCHAR, 9, '0'), if(c_custkey % 5 = 0, c_name, inherited), c_custkey FROM t JOIN customer ON depth = 1 AND c_nationkey = key))
"""


def _tree(spark, sf_dir):
    """The walk is three levels deep, so it is two joins; the path is the pre-order key."""
    pad = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    top = r.select(F.col("r_regionkey").cast("long").alias("id"), F.lit(0).alias("depth"), pad("r_regionkey").alias("path"), F.col("r_name").alias("inherited"))
    middle = n.join(top, F.col("n_regionkey") == F.col("id")).select(F.col("n_nationkey").cast("long").alias("id"), F.lit(1).alias("depth"), F.concat("path", pad("n_nationkey")).alias("path"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.col("inherited")).alias("inherited"))
    low = c.join(middle, F.col("c_nationkey") == F.col("id")).select(F.col("c_custkey").cast("long").alias("id"), F.lit(2).alias("depth"), F.concat("path", pad("c_custkey")).alias("path"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.col("inherited")).alias("inherited"))
    return top.union(middle).union(low)


@query(_TREE + "SELECT id, depth, path FROM t")
def tree_preorder(spark, sf_dir):
    return _tree(spark, sf_dir).select("id", "depth", "path")


@query(_TREE + "SELECT id, depth, path FROM t ORDER BY path LIMIT 1000")
def toc_budget(spark, sf_dir):
    return _tree(spark, sf_dir).select("id", "depth", "path").orderBy("path").limit(1000)


@query(_TREE + "SELECT id, depth, inherited FROM t")
def inherit_nearest(spark, sf_dir):
    return _tree(spark, sf_dir).select("id", "depth", "inherited")


# ---- search

def _counted(rows: DataFrame, needle: str) -> DataFrame:
    """rows without their text, with the number of hits where there are any: within a row, without a shuffle."""
    found = F.size(F.regexp_extract_all("text", F.lit(rel.needle_pattern(needle)), F.lit(0))).cast("long")
    return rows.withColumn("n", found).drop("text").where("n > 0")


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)the'))::BIGINT AS n FROM documents WHERE regexp_matches(text, '(?i)the')")
def search_fold(spark, sf_dir):
    return _counted(table(spark, sf_dir, "documents").select("doc_id", "text"), "the")


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)of[ \\t\\n\\r\\f\\v]+the'))::BIGINT AS n FROM documents WHERE regexp_matches(text, '(?i)of[ \\t\\n\\r\\f\\v]+the')")
def search_elastic_space(spark, sf_dir):
    return _counted(table(spark, sf_dir, "documents").select("doc_id", "text"), "of the")


@query("SELECT doc_id, line::INT AS line, n FROM (SELECT doc_id, unnest(range(len(s))) AS line, unnest(list_transform(s, lambda l: len(regexp_extract_all(l, '(?i)and'))::BIGINT)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE n > 0")
def search_per_line_segments(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return _counted(lines, "and")


@query("SELECT doc_id, ord::INT AS ord, hit FROM (SELECT doc_id, unnest(h) AS hit, unnest(range(len(h))) AS ord FROM (SELECT doc_id, regexp_extract_all(text, '(?i)thth') AS h FROM documents)) WHERE ord < 5")
def search_nonoverlap_cap(spark, sf_dir):
    return rel.hits(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "thth", 5).select("doc_id", "ord", "hit")


@query("WITH g AS (SELECT user_id, event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000, false)::INT AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT g.user_id, g.event_id, (sum(b) OVER (PARTITION BY g.user_id ORDER BY e.ts, e.event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM g JOIN events e ON e.event_id = g.event_id")
def gap_line_islands(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w) > 3_600_000_000
    return rel.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], gap).select("user_id", "event_id", "island")


# ---- filters and encryption

@query("SELECT l_linenumber, l_orderkey, (sum(l_quantity::BIGINT) OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) % 256)::BIGINT AS byte, l_partkey FROM lineitem")
def png_up(spark, sf_dir):
    """Running sums down a column.  A column has few keys, so it is cut into blocks of orders: sums within a block, and of all
    blocks before it; no task holds a whole column."""
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", *order, F.col("l_quantity").cast("long").alias("v"), F.floor(F.col("l_orderkey") / 1024).alias("block"))
    blocks = rows.groupBy("l_linenumber", "block").agg(F.sum("v").alias("total"))
    before = Window.partitionBy("l_linenumber").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    inside = Window.partitionBy("l_linenumber", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made = rows.withColumn("here", F.sum("v").over(inside)).join(offsets, ["l_linenumber", "block"])
    return made.select("l_linenumber", "l_orderkey", ((F.col("here") + F.col("before")) % 256).alias("byte"), "l_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, (sum(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) % 65536)::BIGINT AS sample FROM lineitem")
def tiff_delta(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.sum("l_partkey").over(w) % 65536).alias("sample"))


@query("SELECT doc_id, md5(text) AS same FROM documents")
def ascii_hex(spark, sf_dir):
    packed = F.concat(F.regexp_replace(F.hex(F.encode("text", "UTF-8")), "(....)", "$1 "), F.lit(">junk"))
    digits = F.regexp_replace(F.substring_index(packed, ">", 1), "[^0-9A-Fa-f]", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))).alias("same"))


@query("SELECT o_orderkey, md5('k' || o_orderkey || ':' || o_custkey || 'sAlT') AS key FROM orders")
def object_key_md5(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.concat(F.lit("k"), F.col("o_orderkey").cast("string"), F.lit(":"), F.col("o_custkey").cast("string"), F.lit("sAlT"))).alias("key"))


# ---- functions and colour

@query("SELECT p_partkey, round(0.2 + pow(p_size / 50.0::DOUBLE, 1.7) * 0.6, 9) AS y FROM part")
def func_exponential(spark, sf_dir):
    return table(spark, sf_dir, "part").select(_PART, F.round(sc.exponential(F.col("p_size") / F.lit(50.0), 0.2, 0.8, 1.7), 9).alias("y"))


@query("SELECT p_partkey, round(CASE WHEN p_size < 15 THEN p_size * 2.0 WHEN p_size < 30 THEN pow(p_size, 0.5) ELSE p_size - 30.0 END::DOUBLE, 9) AS y FROM part")
def func_stitching(spark, sf_dir):
    x = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(_PART, F.round(sc.stitched(x, [15.0, 30.0], [lambda v: v * 2.0, lambda v: F.pow(v, F.lit(0.5)), lambda v: v - 30.0]), 9).alias("y"))


@query("SELECT p_partkey, round(CASE WHEN p_size > 25 THEN p_size * p_retailprice - p_size ELSE sqrt(p_retailprice) + abs(-p_size) END, 6) AS y FROM part")
def func_calculator(spark, sf_dir):
    (y,) = sc.calculator("1 index 25 gt { 1 index mul exch sub } { sqrt exch neg abs add } ifelse", F.col("p_size").cast("double"), F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select(_PART, F.round(y, 6).alias("y"))


@query("""WITH t(r, c, s) AS (VALUES (0,0,0.0),(0,1,0.5),(0,2,1.0),(1,0,0.25),(1,1,0.75),(1,2,0.1)), p AS (SELECT p_partkey, least(p_size / 50.0::DOUBLE, 1) * 2 AS u, least((p_partkey % 100) / 99.0::DOUBLE, 1) AS v FROM part),
q AS (SELECT *, least(floor(u), 1) AS i, least(floor(v), 0) AS j FROM p)
SELECT p_partkey, round(sum(s * (1 - abs(u - c)) * (1 - abs(v - r))), 9) AS z FROM q JOIN t ON c BETWEEN i AND i + 1 AND r BETWEEN j AND j + 1 GROUP BY p_partkey""")
def func_sampled_bilinear(spark, sf_dir):
    z = sc.bilinear(F.col("p_size") / F.lit(50.0), F.col(_PART) % 100 / F.lit(99.0), [[0.0, 0.5, 1.0], [0.25, 0.75, 0.1]])
    return table(spark, sf_dir, "part").select(_PART, F.round(z, 9).alias("z"))


@query("SELECT p_partkey, trunc(least(greatest((p_size / 40.0::DOUBLE)::FLOAT, 0::FLOAT), 1::FLOAT) * 255::FLOAT)::BIGINT AS red FROM part")
def rgb_byte(spark, sf_dir):
    return table(spark, sf_dir, "part").select(_PART, sc.colour_byte(F.col("p_size") / F.lit(40.0)).alias("red"))


@query("SELECT p_partkey, if(a IN (0, 255), c, least(255, (c * 255 + a // 2) // a))::BIGINT AS colour FROM (SELECT p_partkey, p_partkey % 256 AS a, p_size * 5 % 256 AS c FROM part)")
def unpremultiply(spark, sf_dir):
    return table(spark, sf_dir, "part").select(_PART, sc.unpremultiplied((F.col("p_size") * 5 % 256).cast("long"), F.col(_PART) % 256).alias("colour"))


@query("SELECT p_partkey, (least(greatest(p_size - 10, 0), 24) * 37 + 11) % 256 AS red FROM part")
def indexed_palette(spark, sf_dir):
    palette = spark.range(25).select(F.col("id").cast("int").alias("i"), ((F.col("id") * 37 + 11) % 256).cast("int").alias("red"))
    return table(spark, sf_dir, "part").withColumn("i", F.least(F.greatest(F.col("p_size") - 10, F.lit(0)), F.lit(24))).join(F.broadcast(palette), "i").select(_PART, "red")  # 25 rows


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 10 AS b, l_tax * 12.5 AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(b * s, 9) AS multiply, round(b + s - b * s, 9) AS screen, round(least(b, s), 9) AS darken, round(greatest(b, s), 9) AS lighten, round(abs(b - s), 9) AS difference, round(b + s - 2 * b * s, 9) AS exclusion FROM p""")
def blend_modes(spark, sf_dir):
    b, s = F.col("l_discount") * 10, F.col("l_tax") * 12.5
    modes = {"multiply": b * s, "screen": b + s - b * s, "darken": F.least(b, s), "lighten": F.greatest(b, s), "difference": F.abs(b - s), "exclusion": b + s - 2 * b * s}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(v, 9).alias(n) for n, v in modes.items()])


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x < -0.3 OR x > 0.3)) = 0 AS clear FROM embeddings")
def color_key_mask(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.forall("embedding", lambda x: (x >= -0.3) & (x <= 0.3)).alias("clear"))


_DIFF = "WITH d AS (SELECT a.vec_id, unnest(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(floor(p[1] * 128) - floor(p[2] * 128))))::BIGINT AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) "


def _diff(spark, sf_dir):
    """Distances of neighbouring vectors' bytes, summed up within the row: nothing is exploded."""
    e = table(spark, sf_dir, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    byte = lambda x: F.floor(x * F.lit(128).cast("float"))
    d = e.join(other, "vec_id").select("vec_id", F.zip_with("embedding", "other", lambda a, b: F.abs(byte(a) - byte(b))).alias("d"))
    over = lambda limit: F.size(F.filter("d", lambda v: v > limit)).cast("long")
    total = F.aggregate("d", F.lit(0).cast("long"), lambda a, v: a + v)
    return d.select("vec_id", over(8).alias("over8"), over(24).alias("over24"), (total / F.size("d")).alias("mean"), F.array_max("d").alias("most"), F.size("d").alias("n"))


@query(_DIFF + "SELECT vec_id, count(*) FILTER (d > 8) AS over8, count(*) FILTER (d > 24) AS over24, round(avg(d), 9) AS mean, max(d) AS most FROM d GROUP BY vec_id")
def pixel_diff(spark, sf_dir):
    return _diff(spark, sf_dir).select("vec_id", "over8", "over24", F.round("mean", 9).alias("mean"), "most")


@query(_DIFF + "SELECT vec_id FROM d GROUP BY vec_id HAVING 100 * count(*) FILTER (d > 24) <= 30 * count(*) AND avg(d) <= 20")
def pixel_gate(spark, sf_dir):
    return _diff(spark, sf_dir).where("100 * over24 <= 30 * n and mean <= 20").select("vec_id")


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 9 THEN p_size + 100 WHEN p_size BETWEEN 10 AND 29 THEN p_size + 490 ELSE 0 END AS cid FROM part")
def cmap_range_join(spark, sf_dir):
    ranges = spark.createDataFrame([(1, 9, 101), (10, 29, 500)], "low int, high int, base int")
    p = table(spark, sf_dir, "part")
    return p.join(F.broadcast(ranges), F.col("p_size").between(F.col("low"), F.col("high")), "left").select(_PART, F.coalesce(F.col("base") + F.col("p_size") - F.col("low"), F.lit(0)).alias("cid"))


@query("SELECT p_partkey, coalesce((map {5: 600, 7: 250, 12: 720})[p_size], 500) AS width FROM part")
def width_lookup(spark, sf_dir):
    return table(spark, sf_dir, "part").select(_PART, F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for v in (5, 600, 7, 250, 12, 720)]), F.col("p_size")), F.lit(500)).alias("width"))


@query("SELECT event_id, event_type FROM events WHERE event_id & 35 = 0 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def annot_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(F.col("event_id").bitwiseAND(F.lit(35)) == 0).join(e.where("event_type = 'purchase'").select("user_id").distinct(), "user_id", "left_semi").select("event_id", "event_type")


@query("SELECT doc_id, least(67108864, greatest(4194304, 8192 * n_chars)) AS pixels FROM documents")
def pixel_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(67_108_864), F.greatest(F.lit(4_194_304), 8192 * F.col("n_chars"))).alias("pixels"))


@query(_LINKS + "SELECT p.page_id, p.url, l.ord::INT AS ord, l.href, regexp_matches(l.href, '^[A-Za-z][A-Za-z0-9+.-]*:') AS external FROM l JOIN pages p USING (page_id) WHERE l.ord < 1000")
def document_links(spark, sf_dir):
    """Which pages link where: links in order, classified, capped per page."""
    p = table(spark, sf_dir, "pages")
    hrefs = F.slice(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), 1, 1000)
    return p.select("page_id", "url", F.posexplode(hrefs).alias("ord", "href")).withColumn("external", sc.has_scheme(F.col("href")))
