"""The registered queries on small tables, against libraries, DuckDB and brute force."""

import collections
import hashlib
import json
import re
import sys
import zlib

import duckdb
import numpy as np
import pytest

sys.path.insert(0, "/opt/tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from folioforge.llm import queries  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts() -> list:
    import random

    pick = random.Random(1)
    words = {"en": "the and of with this house water over".split(), "fr": "le la une avec cette maison été deux".split()}
    made = [" ".join(pick.choice(words[["en", "fr"][k % 2]]) + (str(pick.randrange(99)) if pick.random() < 0.3 else "") for _ in range(pick.choice((5, 60, 120)))) for k in range(40)]
    passage = " ".join(f"p{k}" for k in range(30))
    made += [made[0], made[1], made[1] + " end", "x " + passage + " y", passage + "\n\nz", passage.upper(), "", None, None, "12 34 !!", "Ünïcode ＡＢ 😀 é", "a\tb\x0bc\n\na\tb\n" * 30]
    return made + ["password=abcdef99 AKIA" + "A1" * 10 + " " + "0f" * 13 + " api-key: qZxWvKjTrLmNbHgP7", "<|endoftext|> after", "word " * 400]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [(k * 3 % 101, t, [None, "en", "fr"][k % 3], ["", None, "s1", "s2"][k % 4], len(t or "")) for k, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(at + "/documents.parquet")
    spark.createDataFrame([(r[0], int(k % 5 > 0), 0) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(at + "/labels.parquet")
    urls = [None, "x", "http://A.Net/q", "https://b.example.net/en/1?x", "http://example.com/de/", "http://m.example.com/fr/#t", "ftp://c.org/fr/", "http://c.org", "http://d.info/a b"]
    spark.createDataFrame([(k, u, f"<nav>m</nav><article><p>One&amp;{k}<br>two</p></article>" if k else None) for k, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(at + "/pages.parquet")
    return at


@pytest.fixture(scope="module")
def docs(folder, spark):
    return {r.doc_id: r for r in spark.read.parquet(folder + "/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, folder, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    found = db.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    made = queries.QUERIES[name](spark, folder)
    assert sorted(made.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, made.select(*columns).collect()))) == sorted(map(str, found.fetchall()))


def test_packing(spark, folder, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for d, r in docs.items()}
    covered, sequences = collections.Counter(), collections.defaultdict(list)
    for r in queries.op1_mixture_packing(spark, folder).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert covered == collections.Counter((d, k) for d, x in ids.items() for k in range(len(x)))
    sizes = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(n == 2048 or n < 2048 and n & (n - 1) == 0 for n in sizes)


def test_urls(spark, folder):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op2_url_language_model(spark, folder).collect()}
    assert got[0][:3] == got[1][:3] == ("", "", None) and got[2] == ("a.net", "/q", "net/", "block") and got[3] == ("b.example.net", "/en/1", "example.net/en/", "allow")
    assert got[4] == ("example.com", "/de/", "example.com/de/", "block") and got[5][:3] == ("m.example.com", "/fr/", None) and got[6] == ("c.org", "/fr/", "org/fr/", "allow")
    assert got[7][:3] == ("c.org", "", None) and got[8][:3] == ("d.info", "/a b", None) and {v[3] for v in got.values()} <= {"allow", "block"}


def test_templates(spark, folder):
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op3_site_templates(spark, folder).collect()}
    assert got[0] == ("", 0) and got[4] == ("One&4 two", 9) and len(got) == 9


def test_bpe(spark, folder, docs):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.read().splitlines() if line)}
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op4_byte_bpe(spark, folder).collect():
        text = docs[r.doc_id].text or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_quality(spark, folder, docs):
    for r in queries.op6_risk_controlled_quality(spark, folder).collect():
        text = docs[r.doc_id].text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        count = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeated = {j for k in range(len(words) - 2) if count[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        expected = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_language(spark, folder, docs):
    got = {r.doc_id: r for r in queries.op7_viterbi_language(spark, folder).collect()}
    for d, r in got.items():
        text = docs[d].text or ""
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text)) and r.lang_pred in ("und", "en", "fr")


def test_secrets(spark, folder, docs):
    patterns = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    keeps = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    guesses = 0
    for r in queries.op9_guess_cost_secrets(spark, folder).collect():
        text = docs[r.doc_id].text or ""
        spans = [(m.start(), k, kind, m.end()) for k, kind in enumerate(patterns) for m in re.finditer(patterns[kind], text) if keeps[kind](m)]
        said = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == kind for s in spans) for kind in patterns)
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("guess")] == (said.split(",") if said else [])
        guesses += sum(s.startswith("guess") for s in every)
    assert guesses == 1


def test_names():
    assert len(queries.QUERIES) == 10 and all(re.fullmatch(r"op\d+_\w+", n) for n in queries.QUERIES) and json.dumps(sorted(queries.ORACLE_SQL))
