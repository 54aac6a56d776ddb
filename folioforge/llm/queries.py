"""Registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoded
from .exact import exact_duplicates
from .jaccard import near_duplicates
from .langid import held_out, labelled, trained
from .packing import packed
from .quality import judged
from .secrets import scanned
from .storage import table
from .substrings import without_repeats
from .templates import extracted
from .urls import judged_urls


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the files stay where they are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), digest=True)


#: The rules of the contract.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op2_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encoded(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), decode=True)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


def op6_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = labelled(docs, trained(docs.where(~held_out())), carry=["doc_id"])
    return made.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op8_de_bruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = without_repeats(table(spark, sf_dir, "documents"), texts=False)
    return made.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op9_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scanned(table(spark, sf_dir, "documents"), carry=["doc_id"])
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] != "guess")
    return made.select("row.doc_id", of("assign"), of("access"), of("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")
    return made.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {f.__name__: f for f in (op1_mixture_packing, op2_url_language_model, op3_site_templates, op4_byte_bpe, op5_ngram_jaccard, op6_risk_controlled_quality, op7_viterbi_language, op8_de_bruijn_repeats, op9_guess_cost_secrets, op10_exact_dedup)}

ORACLE_SQL = {
    "op8_de_bruijn_repeats": r"""
        WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
        firsts AS (SELECT t, min((doc_id, i)) AS f FROM windows GROUP BY t HAVING count(*) > 1),
        later AS (SELECT doc_id, i FROM windows JOIN firsts USING (t) WHERE (doc_id, i) > f),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM later),
        lists AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, len(coalesce(ks, []))::BIGINT AS n_removed,
               sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(coalesce(ks, []), k)), lambda k: w[k]), ' '), '')) AS kept_sha256
        FROM words LEFT JOIN lists USING (doc_id)""",
    "op5_ngram_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
            FROM words),
        classes AS (SELECT list_sort(s) AS s, min(doc_id) AS id, count(*) AS copies FROM sets WHERE len(s) > 0 GROUP BY 1),
        grams AS (SELECT id, len(s) AS n, unnest(s) AS g FROM classes),
        counted AS (SELECT id, n, g, count(*) OVER (PARTITION BY g) AS f FROM grams),
        frequent AS (SELECT id, n, g, row_number() OVER (PARTITION BY id ORDER BY f, g) AS r FROM counted),
        prefix AS (SELECT id, n, g FROM frequent WHERE r <= n - ceil(0.85 * n) + 1),
        candidates AS (SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b USING (g) WHERE a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
        pairs AS (
            SELECT a, b FROM candidates c JOIN classes x ON x.id = c.a JOIN classes y ON y.id = c.b
            WHERE 100 * len(list_intersect(x.s, y.s)) >= 85 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
        both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        reach AS (SELECT id AS a, id AS b FROM classes UNION SELECT r.a, p.b FROM reach r JOIN both_ways p ON r.b = p.a),
        roots AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
        links AS (SELECT a AS id, sum(copies) AS n FROM both_ways JOIN classes ON id = b GROUP BY a)
        SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id,
               CASE WHEN len(d.s) = 0 THEN 0 ELSE coalesce(l.n, 0) + c.copies - 1 END::BIGINT AS n_links
        FROM sets d LEFT JOIN classes c ON c.s = list_sort(d.s) LEFT JOIN roots r ON r.id = c.id LEFT JOIN links l ON l.id = c.id""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
