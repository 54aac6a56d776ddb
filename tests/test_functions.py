from pyspark.sql import functions as F

from folioforge.functions import geometry as geo
from folioforge.functions import labels
from folioforge.functions import scalars as sc
from folioforge.operators import relational as rel


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_labels(spark):
    lit = F.lit
    assert one(spark, labels.roman(lit(1994)), labels.roman(lit(4000)), labels.roman(lit(70000)), labels.roman(lit(0))) == ("mcmxciv", "mmmm", "70000", "0")
    assert one(spark, labels.alpha(lit(26)), labels.alpha(lit(27)), labels.alpha(lit(53)), labels.alpha(lit(1665))) == ("z", "aa", "aaa", "1665")
    assert one(spark, labels.label(lit("R"), lit("p"), lit(4)), labels.label(lit(""), lit("p"), lit(4))) == ("pIV", "p")


def test_geometry(spark):
    lit = F.lit
    assert one(spark, *[geo.rotation(lit(d)) for d in (44, 45, -90, 360, 719)]) == (0, 90, 270, 0, 0)
    assert one(spark, *geo.scale_rect(lit(88.92), lit(249.2), lit(100.04), lit(304.28), lit(1.0), lit(612), lit(792))) == (88, 249, 101, 305)
    assert one(spark, geo.to_pixels(lit(float("nan"))), geo.to_pixels(lit(1e300)), geo.to_pixels(lit(-1.5))) == (0, 0, -2)
    assert one(spark, *geo.to_top_left(lit(10.0), lit(20.0), lit(200.0), lit(300.0), lit(90))) == (20.0, 10.0)


def test_scalars(spark):
    lit = F.lit
    assert one(spark, sc.sanitized(lit(" a b\u0007� c ")), sc.without_ligatures(lit("eﬃcient"))) == ("ab c", "efficient")
    assert one(spark, sc.unpremultiplied(lit(100), lit(128)), sc.unpremultiplied(lit(9), lit(0))) == (199, 9)
    assert one(spark, *sc.calculator("3 1 roll", lit(1.0), lit(2.0), lit(3.0))) == (3.0, 1.0, 2.0)
    assert one(spark, *sc.calculator("dup 0 lt { neg } if 2 copy add", lit(5.0), lit(-3.0))) == (5.0, 3.0, 8.0)


def test_search_rules(spark):
    df = spark.createDataFrame([(1, "Alpha  beta alpha\nbeta"), (2, None), (3, "")], "id int, text string")
    assert [(r.id, r.ord, r.hit) for r in rel.hits(df, "text", "alpha beta").orderBy("ord").collect()] == [(1, 0, "Alpha  beta"), (1, 1, "alpha\nbeta")]
    assert rel.hits(df, "text", "  ").count() == 0 and rel.hits(df, "text", "a", 2).count() == 2
    assert rel.hits(spark.createDataFrame([(1, "ſtop")], "id int, text string"), "text", "STOP").count() == 1


def test_calculator_words(spark):
    programs = {"x round": (-3.0, 3.0), "x cvi": (-2.0, 2.0), "x 2 mul 3 idiv": (-1.0, 1.0), "x 2 mul 3 mod": (-2.0, 2.0), "x 0 gt x 1 gt xor": (False, False), "x cvi 3 bitshift": (-16.0, 16.0), "x cvi -28 bitshift": (15.0, 0.0), "x 40 bitshift": (0.0, 0.0)}
    rows = spark.createDataFrame([(-2.5,), (2.5,)], "x double").orderBy("x")
    for program, expected in programs.items():
        words = program.split()
        inputs = [F.col("x")] * words.count("x")
        body = " ".join(w for w in words if w != "x") if words.count("x") == 1 else "0 gt exch 1 gt xor"
        (made,) = sc.calculator(body, *inputs)
        assert tuple(r[0] for r in rows.select(made).collect()) == expected, program
