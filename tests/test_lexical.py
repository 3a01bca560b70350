import pytest
from pyspark.sql import functions as F

from plotmark.operators import lexical


@pytest.mark.parametrize(
    ("positions", "lexemes", "rank"),
    [
        ([], [], 0.0),
        ([1, 5, 9], ["a", "a", "a"], 0.3),
        ([1, 2], ["a", "b"], 0.1),
        ([1, 4], ["a", "b"], 0.1 / 3),
        ([1, 2, 3], ["a", "b", "a"], 0.2),
        ([1, 3, 4, 9], ["a", "a", "b", "c"], 0.1 / (1 + 6 - 2)),
    ],
)
def test_cover_density(spark, positions, lexemes, rank):
    hits = spark.createDataFrame([(list(zip(positions, lexemes, strict=True)),)], "hits array<struct<position:int,lexeme:string>>")
    assert hits.select(lexical.cover_density(F.col("hits"))).first()[0] == pytest.approx(rank)


def test_ranking_needs_no_python_worker_and_time_in_proportion(spark):
    rows = [("q", "c", 3, [(i, "abc"[i % 3]) for i in range(30_000)]), ("q", "d", 1, [(4, "a"), (9, "a")])]
    matches = spark.createDataFrame(rows, "query_id string, chunk_id string, needed long, hits array<struct<position:int,lexeme:string>>")
    ranked = lexical.rank_matches(matches)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert {r.chunk_id: round(r.text_rank, 6) for r in ranked.collect()} == {"c": round(0.1 * 29_998, 6), "d": 0.2}


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("gas", "gas"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"),
        ("relational", "relat"), ("conditional", "condit"), ("generally", "general"), ("happy", "happi"), ("say", "say"), ("by", "by"), ("skies", "sky"),
        ("dying", "die"), ("news", "news"), ("proceed", "proceed"), ("adjustment", "adjust"), ("effective", "effect"), ("controlling", "control"), ("knightly", "knight"),
        ("consistency", "consist"), ("lanterns", "lantern"), ("village", "villag"), ("communication", "communic"), ("national", "nation"), ("running", "run"), ("étude", "étude"),
    ],
)
def test_stems(word, stem):
    assert lexical.PorterStemmer().stem(word) == stem


def test_lexemes_and_matches(spark):
    texts = spark.createDataFrame([("c1", "a", "The tall lighthouse is 31.5 m"), ("c2", "a", "Lighthouses of the west"), ("c3", "b", "tall lighthouse"), ("c4", "a", None)], "chunk_id string, address_id string, text string")
    own = lexical.lexemes(texts, "english", ("chunk_id", "address_id"))
    got = {(r.chunk_id, r.lexeme): r.positions for r in own.collect()}
    assert got[("c1", "lighthous")] == [3] and got[("c1", "31.5")] == [5] and ("c1", "the") not in got and got[("c2", "lighthous")] == [1]
    queries = spark.createDataFrame([("q1", "a", "tall lighthouses"), ("q2", "a", "the"), ("q3", "b", "west")], "query_id string, address_id string, query_text string")
    matches = lexical.match_all(own, lexical.query_lexemes(queries))
    assert {(r.query_id, r.chunk_id) for r in matches.collect()} == {("q1", "c1")}
    assert lexical.rank_matches(matches).first().text_rank == pytest.approx(0.1)
    with pytest.raises(ValueError):
        lexical.lexemes(texts, "german")


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("foo-bar-beta1", ["foo-bar-beta1", "foo", "bar", "beta1"]),
        ("http://example.com/stuff/index.html", ["example.com/stuff/index.html", "example.com", "/stuff/index.html"]),
        ("https://Example.com:8080", ["example.com:8080"]),
        ("Write to Joe.Doe+x@mail.example.org, or not.", ["write", "to", "joe.doe+x@mail.example.org", "or", "not"]),
        ("-12.5 +7 42 3e-4 8.3.0", ["-12.5", "+7", "42", "3e-4", "8.3.0"]),
        ("a mat - it ate", ["a", "mat", "it", "ate"]),
        ("the 3rd éclair-shop, naïve", ["the", "3rd", "éclair-shop", "éclair", "shop", "naïve"]),
        ("(see example.com/a?b=c).", ["see", "example.com/a?b=c", "example.com", "/a?b=c"]),
        ("snake_case it's", ["snake", "case", "it", "s"]),
        (None, []),
    ],
)
def test_kinds_of_words(spark, text, words):
    assert spark.createDataFrame([(text,)], "t string").select(lexical.words(F.col("t"), kinds=True).alias("w")).first().w == words


def test_kinds_leave_plain_prose_as_it_is(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.regexp_replace("text", "[^\\p{L}\\n ]", " ").alias("t"))
    assert docs.filter(lexical.words(F.col("t"), kinds=True) != lexical.words(F.col("t"))).count() == 0 < docs.count()


def test_lexemes_of_unique_ids_need_no_shuffle(spark):
    texts = spark.createDataFrame([("c1", "cat a CAT, doings of the cats"), ("c2", None), ("c3", ""), ("c1", "a")], "chunk_id string, text string")
    for config in lexical.CONFIGS:
        own, merged = lexical.lexemes(texts, config, merged=False), lexical.lexemes(texts, config)
        assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r.chunk_id, r.lexeme, tuple(r.positions)) for r in own.collect())
        assert [r for r in rows if r[1] == "cat"] == [("c1", "cat", {"english": (1, 3, 7)}.get(config, (1, 3)))]
        assert (rows.count(("c1", "a", (1,))), rows.count(("c1", "a", (2,)))) == ((1, 1) if config == "simple" else (0, 0)) and {r[0] for r in rows} == {"c1"}
        assert ({(r.chunk_id, r.lexeme): r.positions for r in merged.collect()}.get(("c1", "a")) == [1, 2]) == (config == "simple")


def test_postings_are_not_dealt_out_for_a_few_queries(spark):
    texts = spark.range(300).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("a").alias("address_id"), F.concat(F.lit("tall house "), "id").alias("text"))
    queries = spark.createDataFrame([("q1", "a", "house tall"), ("q2", "a", "house 7")], "query_id string, address_id string, query_text string")
    own = lexical.lexemes(texts.union(texts.filter("chunk_id = 'c7'")), "simple", ("chunk_id", "address_id"), merged=False)  # c7 twice
    found = lexical.match_all(own, lexical.query_lexemes(queries, "simple"))
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.chunk_id): len(r.hits) for r in found.collect()}
    assert len(got) == 301 and got["q2", "c7"] == got["q1", "c7"] == 4 and got["q1", "c8"] == 2
