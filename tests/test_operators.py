"""Quirks and edge cases, one by one, and properties against plain Python."""

import random
import sqlite3

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citespan.functions import paths, text
from citespan.operators import blocks, evidence, fts, grams, lookup, summaries, tree
from citespan.operators.extract.run_configs import text_lines


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select(expr(F.col("v")), "i").orderBy("i").collect()]


def test_lines(spark):
    values = ["a\nb\r\n", "", "x\n\n", "\n", "a\rb", "a\r\r\n"]
    want = [["a", "b"], [], ["x", ""], [""], ["a\rb"], ["a\r"]]
    assert column(spark, values, text.lines) == want and [text_lines(v) for v in values] == want


def test_paths(spark):
    assert column(spark, ["a.tar.gz", ".bashrc", "a.", "x/A.TSX", "noext"], paths.extension) == ["gz", None, "", "tsx", None]
    assert column(spark, ["A.TSX", "x.h", ".bashrc", "a.kt"], paths.language) == ["typescript", "c", None, "kotlin"]
    assert column(spark, ["a/b/c", "a", ""], paths.parent_dir) == ["a/b", "", ""]
    assert column(spark, ["ssh://git@h/p.git", "https://h/p.git", "", "git@h:t/p.git.git", "git@h", "x"], paths.web_url) == ["https://h/p", "https://h/p", None, "https://h/t/p", None, "x"]


def test_like_folds_ascii_only(spark):
    names = ["Cache", "ÉCOLE", "aXb", "a_b", "per%cent", "back\\slash"]
    db = sqlite3.connect(":memory:")
    for needle in ("cache", "école", "a_b", "%", "AXB", "\\", "R%C", "É"):
        want = [n for n in names if db.execute("SELECT ? LIKE ?", (n, f"%{needle}%")).fetchone()[0]]
        df = spark.createDataFrame([(n,) for n in names], "name string").filter(text.like_folded(F.col("name"), needle))
        assert sorted(r.name for r in df.collect()) == sorted(want), needle


def test_search_columns_and_dialect(spark):
    df = spark.createDataFrame([("p", "é\U0001d11eab needle needle\nx  "), ("q", None)], "path string, content string")
    assert [tuple(r) for r in lookup.search(df, "needle").collect()] == [("p", 1, 6, "é\U0001d11eab needle needle")]
    assert lookup.search(df, "x *$").first().snippet == "x" and lookup.search(df, "x$").count() == 0
    for bad in ("a(?=b)", "(a)\\1", "(?<!x)y", "a("):
        with pytest.raises(ValueError):
            lookup.search(df, bad)
    long = spark.createDataFrame([("p", "n" * 300)], "path string, content string")
    assert lookup.search(long, "n").first().snippet == "n" * 200 + "…"


@pytest.mark.parametrize("extra,omitted", [(0, 0), (1, 1)])
def test_listing_budget(spark, extra, omitted):
    df = spark.createDataFrame([(f"{i:03d}{'x' * 96}",) for i in range(400 + extra)], "path string")
    rows = lookup.list_files(df).collect()
    assert len(rows) == 400 and rows[0].omitted == omitted and rows[0].total == 400 + extra


def test_capped(spark):
    def cap(content):
        n = len(text_lines(content))
        df = spark.createDataFrame([("p", 1, n, n, content)], "path string, start_line int, end_line int, total_lines int, content string")
        return lookup.capped(df, 10).first()

    assert cap("short").truncated is None
    r = cap("abc\ndefg\nhijk\nl")
    assert (r.content, r.end_line) == ("abc\ndefg", 2) and "returned 8 of 15 bytes" in r.truncated and "start_line=3" in r.truncated
    assert cap("é" * 8).content == "é" * 5 and cap("a" + "é" * 8).content == "a" + "é" * 4 and cap("ab\U0001d11e\U0001d11e\U0001d11e").content == "ab\U0001d11e\U0001d11e"


spans = st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 30), st.integers(0, 6)), max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(spans)
def test_merge_covers_the_same_lines(spark, rows):
    rows = [(p, s, s + n) for p, s, n in rows]
    out = [tuple(r) for r in evidence.merge_spans(spark.createDataFrame(rows, "path string, start_line int, end_line int")).collect()]
    cover = lambda rs: {(p, i) for p, s, e in rs for i in range(s, e + 1)}
    assert cover(rows) == cover(out)
    assert all(b[1] > a[2] + 1 for a, b in zip(sorted(out), sorted(out)[1:]) if a[0] == b[0])


def test_footer(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("a", 11, 12), ("a", 2, 3), ("a", 11, 11), ("b", 7, 7)], "path string, start_line int, end_line int")
    touched = spark.createDataFrame([("c",), ("a",)], "path string")
    assert evidence.sources_footer(df, touched).first().footer == "\n\n**Sources:**\n- a:1-9\n- a:11-12\n- b:7\n\n*Also examined:* c\n"
    assert evidence.sources_footer(df.limit(0), touched.limit(0)).first().footer == ""


def test_tree_cap(spark):
    df = spark.createDataFrame([(f"d/f{i:02d}",) for i in range(30)] + [("d/e/x/y/z",), ("r",)], "path string")
    got = {r.node: r for r in tree.dir_tree(df).collect()}
    assert got["d"].files == 31 and got["d"].more_children == 6 and len([n for n in got if n.startswith("d/") and n.count("/") == 1]) == 25
    assert got["d/e/x"].more_children == 0 and "d/e/x/y" not in got and got["r"].files == 0 and not got["r"].is_dir


def test_sanitize():
    assert fts.sanitize("foo-bar baz*") == '"foo-bar" "baz"*' and fts.sanitize("plain words") == "plain words" and fts.sanitize('"a:b') == '"a:b' and fts.sanitize("path:x") == '"path:x"'


DOCS = [("a", "The running cache keeps cached rows"), ("b", "Caching is hard; caches run"), ("c", "nothing relevant here"), ("d", "run run runner cache line of the text"), ("e", "relational ponies happily hopping"), ("f", "École générale, relation happy hops"), ("g", "")]


@pytest.mark.parametrize("query", ["cache", "run cache", "cache OR nothing", "cache NOT rows", '"cached rows"', "cac*", "happy", "relational", "ecole", "the", "cache + line", "(run OR nothing) AND here", "pony hop"])
def test_ranking_matches_fts5(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(path UNINDEXED, summary, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?)", DOCS)
    want = {p: r for p, r in db.execute("SELECT path, bm25(t) FROM t WHERE t MATCH ?", (query,))}
    df = spark.createDataFrame(DOCS, "path string, summary string")
    made = fts.postings(df)
    got = {r.path: r.rank for r in fts.rank(made, fts.doc_lengths(df), query).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got)


@pytest.mark.parametrize("query", ["foo.bar", "src/main.rs", "it's", "a,b", "AND", "(a", ""])
def test_query_errors(query):
    with pytest.raises(fts.QueryError):
        fts.parse_query(query)


@pytest.mark.parametrize("word", "caresses ponies ties caress cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer radically differently analogous vietnamization predication operator feudalism decisiveness hopefulness formality sensitivity triplicate formative electricity electrical goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption communism activate effective probate rate cease controlling rolling abilities".split())
def test_stem_matches_sqlite(word):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter ascii')")
    db.execute("INSERT INTO t VALUES (?)", (word,))
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, row)")
    assert fts.stem(word) == db.execute("SELECT term FROM v").fetchone()[0]


def test_summaries(spark):
    contents = spark.createDataFrame([("a/x.py", "python", "# hello\nz", b"1"), ("b", None, "", b"2"), ("c", None, None, b"3")], "path string, lang string, content string, hash binary")
    made = summaries.summarize(contents)
    assert {r.path: r.summary for r in made.collect()} == {"a/x.py": "x.py (python): hello", "b": "b (text): "}
    files = contents.select("path", "hash", "lang")
    stale = made.withColumn("source_hash", F.when(F.col("path") == "b", F.lit(b"0")).otherwise(F.col("source_hash")))
    assert {r.path: r.summary for r in summaries.valid_file_summaries(files, stale).collect()} == {"a/x.py": "x.py (python): hello", "b": None, "c": None}
    dirs = spark.createDataFrame([("a", b"h"), ("", b"r")], "dir_path string, child_hash binary")
    none = spark.createDataFrame([], "dir_path string, summary string, child_hash binary")
    valid = summaries.valid_dir_summaries(dirs, none, files, stale)
    assert summaries.dir_prompts(valid).filter("dir_path = 'a'").first().prompt == "Directory: a\n- a/x.py: x.py (python): hello\n"
    assert summaries.dir_prompts(valid, 20).filter("dir_path = 'a'").first().prompt == "Directory: a\n[truncated]\n"
    boom = summaries.summarize(contents, lambda p, lang, t: 1 / 0)
    assert boom.count() == 0


def test_sessions(spark):
    log = spark.createDataFrame([(1, 0, 5), (1, 1, 7), (2, 0, 1)], "session int, seq int, cost long")
    assert [(r.session, r.used, r.note) for r in evidence.session_usage(log).orderBy("session", "seq").collect()] == [(1, 5, "5 / 200000 chars used"), (1, 12, "12 / 200000 chars used"), (2, 1, "1 / 200000 chars used")]
    calls = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "b", 2)], "session int, name string, seq int")
    back = spark.createDataFrame([(1, "a", 5), (1, "b", 4)], "session int, name string, seq int")
    assert {(r.name, r.call_seq, r.response_seq) for r in evidence.pair_calls(calls, back).collect()} == {("a", 0, 5), ("a", 1, None), ("b", 2, 4)}


GRAMMAR = ["ones*", "happily*", "one (two)", "(one) two", "NEAR(one five)", "NEAR(one five, 2)", 'NEAR("one two" five, 1)', "NEAR(one)", "^one", "^ one", '^"one two"', "one ^two", "summary : one", "path : one", "{path summary} : one", "-path : one", "- {path} : one", "summary : (one OR two) AND five", "summary : one two", "nope : one", "summary : NEAR(one five)", "NEAR(one five) OR two", "NEAR (one five)", "NEAR one", "near(one five)", '"NEAR" one', "^one + two", "one + ^two", "NEAR(^one five,3)", "one AND NEAR(two, 5)", "NEAR(one, x)", '"summary" : one', "summary:^one", "summary : - one", "SUMMARY : one", "one NOT (two)", "NEAR(one* five, 0)", "NEAR(one+two five, 9)", "^one*", "path : one OR two", "summary : path : one", '"one" : one', "{} : one", "(one two) three", "(one OR two) (three)", "one OR two three", "one two OR three", "NEAR(one two x five, 2)", "NEAR(two one, 0)", "NEAR(x x, 1)", "five NOT NEAR(one five, 1)"]
TEXTS = [("a", "one two three four five"), ("b", "one five two"), ("c", "two one one x x x x five one two"), ("d", "five x one x two x three"), ("e", "x x x x"), ("f", "two two one five five one"), ("g", None), ("h", "")]


@pytest.mark.parametrize("query", GRAMMAR)
def test_grammar_matches_fts5(query):
    """Every form of a query matches, ranks or fails as in the engine; evaluated without Spark, block by block."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(path UNINDEXED, summary, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?)", [t for t in TEXTS if t[1] is not None])
    try:
        want = {p: r for p, r in db.execute("SELECT path, bm25(t) FROM t WHERE t MATCH ?", (query,))}
    except sqlite3.OperationalError as e:
        with pytest.raises(fts.QueryError) as got:
            fts.parse_query(query)
        assert str(got.value) == str(e)
        return
    tree, docs = fts.parse_query(query), [(p, fts.tokens(t)) for p, t in TEXTS if t is not None]
    rows = {}
    for term in {w for _, ws in docs for w in ws}:
        at = [(i, ws.count(term), len(ws), [k for k, w in enumerate(ws) if w == term]) for i, (_, ws) in enumerate(docs) if term in ws]
        names = [c.split()[0] for c in blocks.TERM_BLOCKS.split(", ")]
        rows[term] = dict(zip(names, blocks._row("0", 0, term, [x[0] for x in at], [x[1] for x in at], [x[2] for x in at], [k for x in at for k in x[3]])))
    lists = blocks.Lists(rows, len(docs))
    df = [int((blocks.occurrences(lists, p) > 0).sum()) if p.op == "PHRASE" and p.tokens else 0 for p in fts.ranked_phrases(tree)]
    mean = sum(len(ws) for _, ws in docs) / len(docs)
    weights = blocks._weights(blocks.Corpus(len(docs), mean), df)
    hits, total = blocks._scores(lists, tree, weights, mean)
    got = {docs[i][0]: -s for i, s in zip(hits, total)}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got)
    assert not got or blocks._bound(rows, tree, iter(weights), mean) >= max(total) - 1e-12


def test_block_search(spark, monkeypatch):
    """The best of blocks are the best of all postings, and blocks below them aren't evaluated."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = [(f"p{i:04d}", " ".join(rng.choices(words, [1 / (k + 1) for k in range(30)], k=rng.randint(1, 40)))) for i in range(900)] + [("z", "w29 w29 w29")]
    docs += [(f"q{i:03d}", "w0 w3 w5") for i in range(50)]  # ties
    df = spark.createDataFrame(docs, "path string, summary string")
    made = blocks.build(fts.tokenized(df, False), 3).cache()
    terms, texts, postings, lengths = blocks.term_blocks(made), blocks.doc_blocks(made), fts.postings(df, False).cache(), fts.doc_lengths(df, False)
    for query in ("w29", "w0 w3", "w29 OR w28", '"w0 w1" OR w7', "w2* NOT w20", "NEAR(w5 w6, 3)", "^w4 OR w11", "absent", "w0 w3 w5"):
        got = [tuple(r) for r in blocks.search(terms, texts, query, 7, False).collect()]
        want = fts.rank(postings, lengths, query, False).orderBy(F.round("rank", 9), "path").limit(7)
        assert [p for p, _ in got] == [r.path for r in want.collect()], query
    report = blocks.search_report(terms, texts, "w29", 1, False).first()
    assert report.evaluated < report.blocks


@pytest.mark.parametrize("stemmed", [False, True])
def test_search_of_texts(spark, stemmed):
    """Without an index the best are those of all postings; texts without tokens or without the terms count as texts."""
    rng = random.Random(3)
    words = [f"w{i}s" for i in range(30)]
    docs = [(f"p{i:04d}", " ".join(rng.choices(words, [1 / (k + 1) for k in range(30)], k=rng.randint(0, 40)))) for i in range(900)]
    docs += [(f"q{i:03d}", "w0s w3s w5s") for i in range(50)] + [("null", None), ("empty", ""), ("signs", "--"), ("Ä", "Ähre W29S ähre")]
    df = spark.createDataFrame(docs, "path string, summary string").repartition(3)
    postings, lengths = fts.postings(df, stemmed).cache(), fts.doc_lengths(df, stemmed)
    for query in ("w29s", "w0s w3s", "w29s OR w28s", '"w0s w1s" OR w7s', "w2* NOT w20s", "NEAR(w5s w6s, 3)", "^w4s OR w11s", "absent", "w0s w3s w5s", "ahre OR ähre", '"--"', "path : w3s"):
        got = blocks.best_of_texts(df, query, 7, stemmed)
        want = fts.rank(postings, lengths, query, stemmed).orderBy(F.round("rank", 9), "path").limit(7).collect()
        assert [p for p, _ in got] == [r.path for r in want] and [r for _, r in got] == pytest.approx([r.rank for r in want], abs=1e-9), query
    assert blocks.best_of_texts(df.limit(0), "w0s", 7, stemmed) == []


def test_postings_of_terms_alone(spark):
    """Only the terms' postings are made, and a row of what was read for each run of texts."""
    df = spark.createDataFrame([("a", "x y x"), ("b", "z"), ("c", ""), ("d", "yy X")], "path string, summary string").coalesce(1)
    got = {(r.term, r.path, r.doc_length, r.tf, tuple(r.positions)) for r in fts.postings_with(df, [("x", False), ("y", True)], False).collect()}
    assert got == {("x", "a", 3, 2, (0, 2)), ("y", "a", 3, 1, (1,)), ("x", "d", 2, 1, (1,)), ("yy", "d", 2, 1, (0,)), ("", None, 4, 6, ())}


@pytest.mark.parametrize(
    "pattern,ignore_case,wanted",
    [("hello", False, ("and", ["ell", "hel", "llo"])), ("licen[sc]e", False, None), ("ab", False, True), ("a.c", False, True), ("abc.*xyz", False, ("and", ["abc", "xyz"])), ("(abc|xyz)+", False, ("or", ["abc", "xyz"])),
     ("abc|x", False, True), ("(?:abc)?xyz", False, None), ("ABC", False, "abc"), ("task", True, True), ("label", True, ("and", ["abe", "bel", "lab"])), ("ÄBC", True, True), (r"\\bfoo\\(", False, None), (r"foo\\x{41}", False, True), ("[[:alpha:]]abc", False, True), ("(?=abc)", False, True), ("a{3}bcd", False, "bcd")],
)
def test_condition(pattern, ignore_case, wanted):
    got = grams.condition(pattern.replace("\\\\", "\\"), ignore_case)
    assert got == wanted if wanted is not None else got is not True


_PIECES = st.sampled_from(["a", "b", "ab", "abc", "B", ".", "[ab]", "[a-c]", "[^a]", r"\w", "k", "(ab|c)", "(?:abc)?", "c+", "a*", "(b|ab)*", "a{2}", "b{1,2}", "^", "$", r"\b", "(a|bc|)", "|", "ä", "s"])


@settings(max_examples=600, deadline=None)
@given(st.lists(_PIECES, min_size=1, max_size=7).map("".join), st.lists(st.sampled_from(list("abcABkKsSÄä ") + ["\n", "\u212a", "\u017f"]), max_size=14).map("".join), st.booleans())
def test_every_match_meets_the_condition(pattern, text, ignore_case):
    import re

    if re.search(f"(?m){pattern}", text, re.I if ignore_case else 0) and any(re.search(pattern, line, re.I if ignore_case else 0) for line in text.split("\n")):
        assert grams.met(grams.condition(pattern, ignore_case), grams.grams_of(text))


def test_candidates(spark):
    rows = [("a", "a license here"), ("b", "the LICENCE"), ("c", "lice and sense"), ("d", None), ("e", "")]
    index = grams.gram_rows(spark.createDataFrame(rows, "path string, content string"))
    assert {r.path for r in grams.candidates(index, grams.condition("licen[sc]e")).collect()} == {"a", "b"}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abcABkKÄß \n\r\0") + ["\U0001f600"]), max_size=12), min_size=1, max_size=9))
def test_grams_of_a_block(texts):
    """A block says of each text the grams that it has by itself."""
    found, ords = grams._block(texts)
    got = {(g, int.from_bytes(o[i : i + 2], "little")) for g, o in zip(found, ords) for i in range(0, len(o), 2)}
    assert got == {(g, i) for i, t in enumerate(texts) for g in grams.grams_of(t)} and found == sorted(found) and all(ords)


def test_grams_of_many_characters():
    """Gram and text of a block with very many characters don't fit one number."""
    test_grams_of_a_block.hypothesis.inner_test(["".join(map(chr, range(0x10000, 0x10000 + 70_000))), *["abc", "\U00010000\U00010001\U00010002"] * 2048])


def test_candidates_of_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"p{i:03d}", None if i % 50 == 0 else " ".join(rng.choices(["a license", "the LICENCE", "lice", "sense", "and", ""], k=3))) for i in range(300)]
    df = spark.createDataFrame(rows, "path string, content string").repartition(3)
    index = grams.gram_blocks(df).cache()
    # A gram has one row in a block, however many texts hold it.
    assert index.count() <= 3 + 3 * grams.gram_rows(df).select("gram").distinct().count()
    for pattern in ("licen[sc]e", "lice and|LICENCE", "sense.*the", "absent"):
        wanted = grams.condition(pattern)
        want = sorted(r.path for r in grams.candidates(grams.gram_rows(df), wanted).collect())
        assert sorted(r.path for r in grams.candidates_of_blocks(index, wanted).collect()) == want, pattern
