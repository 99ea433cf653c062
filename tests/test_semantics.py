"""Hand-worked cases of the rules that are easy to get wrong."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodeweave.functions import measures as M
from lodeweave.functions import text as T
from lodeweave.operators import catalog, cleaning, components, incremental, joins, kernels, packed, sequences, votes
from lodeweave.plans import terms
from lodeweave.sources import files


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_score_counts_missing_before_sum(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 9, 9), (1, 9, 1)], "k int, a int, b int")
    u, s = votes.weighted_score([(10, F.col("a")), (0, F.lit(None).cast("int")), (1, F.col("b"))])
    got = votes.argmin(df.withColumns({"u": u, "s": s}), ["k"], [F.col("u"), F.col("s")]).first()
    assert (got["u"], got["s"]) == (0, 91)  # a weight of 0 counts neither way


def test_majority_ties_by_casing(spark):
    df = spark.createDataFrame([(1, v) for v in ("the End", "The End", "THE END", None)], "k int, v string")
    assert votes.majority(df, ["k"], "v").first()["v"] == "The End"
    assert votes.majority(df.limit(0), ["k"], "v").count() == 0


def test_plurality_needs_a_unique_leader(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "b"), (2, "x"), (3, "y"), (3, "y")], "k int, v string")
    assert [tuple(r) for r in votes.plurality(df, ["k"], "v").collect()] == [(3, "y", 2)]


def test_album_key_of_two_years(spark):
    df = spark.createDataFrame([(1, "A", 2001), (2, "A", 2002), (3, "A", None), (4, "B", 1999), (5, "B", None), (6, None, 1)], "n int, a string, y int")
    got = {r["n"]: r["album_key"] for r in votes.album_key(df, F.col("a"), "y").collect()}
    assert got == {1: "A|2001", 2: "A|2002", 3: "A", 4: "B|1999", 5: "B|1999", 6: None}


@pytest.mark.parametrize(
    ("case", "points", "verdict"),
    [
        ({"title": True, "credits": True}, 8, "same"), ({"title": False, "credits": False}, -13, "other"), ({"title": False, "credits": False, "identifier": True}, -1, "same"),
        ({"credits": False}, -5, "unsure"), ({"title": True, "credits": False, "release": False}, 0, "unsure"), ({"unit": False, "title": True, "credits": True}, 1, "unsure"), ({}, 0, "same"),
    ],
)
def test_evidence(spark, case, points, verdict):
    e = {k: F.lit(case.get(k)).cast("boolean") for k in ("identifier", "title", "credits", "length", "release", "unit")}
    assert one(spark, votes.points(e), votes.verdict(e, votes.points(e))) == (points, verdict)


def test_print_verdict(spark):
    v = lambda n, s, c: one(spark, sequences.print_verdict(F.lit(n), F.lit(s), F.lit(c)))[0]
    assert [v(60, 0.3, 0.8), v(20, 0.5, 0.9), v(20, 0.4, 0.9), v(60, 0.1, 0.8), v(60, 0.3, 0.1), v(7, 1.0, 1.0)] == ["same", "same", "unsure", "unsure", "unsure", "different"]


def test_prints_find_a_shifted_copy(spark):
    r = np.random.default_rng(3)
    a = r.integers(0, 2**32, 200).tolist()
    b = r.integers(0, 2**32, 30).tolist() + [x ^ 0b101 for x in a]
    c = r.integers(0, 2**32, 200).tolist()
    df = spark.createDataFrame([(1, a), (2, b), (3, c), (4, [7] * 50)], "id int, words array<bigint>")
    p = sequences.prints_long(df, "id", "words")
    assert p.filter("id = 4 AND sounding").count() == 0
    got = {(x["a"], x["b"]): (x["offset"], x["agreeing"], x["verdict"]) for x in sequences.print_matches(p, "id", spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), "a", "b").collect()}
    assert got[1, 2] == (-30, 200, "same")
    assert got.get((1, 3), (0, 0, "different"))[2] == "different"


def test_stamps_and_lines(spark):
    df = spark.createDataFrame([(1, "[00:01.5]a\n[00:02.00][00:09.00]b\nplain\n[00:70.00]c"), (2, None), (3, "")], "id int, x string")
    got = [(r["id"], r["ms"], r["words"]) for r in sequences.timed_lines(df, "id", "x").orderBy("id", "line", "ms").collect()]
    assert got == [(1, 1500, "a"), (1, 2000, "b"), (1, 9000, "b"), (1, None, "plain"), (1, None, "c"), (3, None, "")]
    lines = spark.createDataFrame([(1, 1, 500, "x"), (1, 2, 900, "y"), (1, 3, 3000, "z")], "id int, line int, ms bigint, words string")
    assert [(r["ms"], r["words"]) for r in sequences.shifted(lines, "id", -1000, 0).orderBy("ms").collect()] == [(0, "y"), (2000, "z")]
    typed = spark.createDataFrame([(1, i, i * 10, w) for i, w in enumerate(["h", "he", "hey", "ho"])], "id int, line int, ms bigint, words string")
    assert [r["words"] for r in sequences.typed_out(typed, "id").orderBy("ms").collect()] == ["hey", "ho"]


def test_length_bands_against_all_pairs(spark):
    r = np.random.default_rng(1)
    n = [int(x) for x in r.integers(1, 400, 60)]
    df = spark.createDataFrame([(i, x, i % 2) for i, x in enumerate(n)] + [(99, None, 0), (98, 0, 0)], "id int, n int, b int")
    got = {(x["key_a"], x["key_b"]) for x in joins.length_band_pairs(df, "id", "n", 0.8, ["b"]).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and min(n[i], n[j]) >= 0.8 * max(n[i], n[j])}


def test_similar_sets_against_all_pairs(spark):
    r = np.random.default_rng(5)
    texts = []
    for i in range(40):
        base = [f"w{x}" for x in r.integers(0, 60, 100)]
        texts += [" ".join(base), " ".join([*base[: 20 + i % 15], "zz", *base[21 + i % 15 :]])]
    texts += [texts[0], "", None, "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    got = {(x["key_a"], x["key_b"]) for x in joins.similar_sets(df, "id", T.words(F.col("x"))).collect()}
    sets = {}
    for i, x in enumerate(texts):
        w = (x or "").split()
        s = frozenset(" ".join(w[j : j + 5]) for j in range(len(w) - 4)) or (frozenset([" ".join(w)]) if w else None)
        if s and s not in sets.values():
            sets[i] = s
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert got == want and want
    classes = {r["id"]: r["class_id"] for r in joins.near_duplicate_classes(df, "id", T.words(F.col("x"))).collect()}
    assert classes[80] == classes[0] == 0 and 81 not in classes and classes[83] == 83


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (51, 50), (60, 60), (None, 3)], "a int, b int")
    got = {r["node"]: r["label"] for r in components.components(e).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50, 60: 60}
    assert components.components(e.limit(0)).count() == 0


def test_assignment_against_all(spark):
    from itertools import permutations

    r = np.random.default_rng(2)
    for n, m in ((3, 3), (3, 5), (4, 3)):
        c = r.integers(0, 20, (n, m)).astype(float)
        got = kernels.least_cost(c)
        cost = sum(c[i, j] for i, j in enumerate(got) if j is not None)
        k = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(p, q)) for p in permutations(range(n), k) for q in permutations(range(m), k))
        assert sum(j is not None for j in got) == k and cost == best
    assert kernels.least_cost(np.array([[np.inf, np.inf]])) == [None]
    assert kernels.least_cost(np.array([[1.0, 1.0]])) == [0]


def test_allocation():
    items = [[(100, 0, 0), (60, 1, 0), (30, 5, 0)], [(100, 0, 0), (50, 4, 0)]]
    assert kernels.allocate(items, 1000) == [0, 0]
    assert kernels.allocate(items, 160) == [1, 0]
    assert kernels.allocate(items, 79) is None
    assert kernels.hull([(0, 0), (40, 5), (70, 5)]) == [0, 2]


def test_logistic_and_names():
    x = np.array([[0.0], [1.0], [2.0], [3.0]] * 10)
    y = np.array([0, 0, 1, 1] * 10)
    w = kernels.logistic(x, y)
    assert w[1] > 0 and kernels.logistic(x, y * 0) is None
    assert kernels.name_distance("The Owl", "the owl") == 0.0
    assert kernels.name_distance("", "x") is None
    assert kernels.monge_elkan(["a", "b"], ["b", "a"]) == 1.0
    assert kernels.best_shift(np.sin(np.arange(60) / 3), np.sin((np.arange(60) + 4) / 3), 8)[0] == 4


def test_unique_evidence_passes_on(spark):
    a = spark.createDataFrame([("g1", "s", "b1"), ("g2", "s", "b2"), ("g3", None, "b3")], "gone string, stamp string, bytes string")
    b = spark.createDataFrame([("n1", "s", "b1"), ("n2", "t", "b2"), ("n3", "u", "b9")], "new string, stamp string, bytes string")
    got = {(r["gone"], r["new"], r["by"]) for r in joins.pair_by_unique_evidence(a, b, "gone", "new", ["stamp", "bytes"]).collect()}
    assert got == {("g1", "n1", "bytes"), ("g2", "n2", "bytes")}


def test_query_language(spark):
    views = spark.createDataFrame(
        [
            Row(song_no=1, keys=["yt:a"], tags={"title": ["Café Owl"], "date": ["2001-02"], "artist": ["X", "Yé"]}, path="m/Owl.opus", cover=True, soft_cover=False, lyrics=True, timed=True, given=["mood"], **{"from": ["yt"]}),
            Row(song_no=2, keys=["yt:b"], tags={"title": ["Other"]}, path="m/b.opus", cover=False, soft_cover=False, lyrics=False, timed=None, given=None, **{"from": None}),
        ],
        "song_no int, keys array<string>, tags map<string,array<string>>, path string, cover boolean, soft_cover boolean, lyrics boolean, timed boolean, given array<string>, `from` array<string>",
    )
    find = lambda q: [r["song_no"] for r in views.filter(terms.predicate(terms.parse(q, {"yt"}))).orderBy("song_no").collect()]
    assert find([]) == [1, 2]
    assert find(["cafe"]) == [1] and find(["CAFÉ owl"]) == [1]
    assert find(["^artist:x"]) == [2] and find(["artist:=ye"]) == [1]
    assert find(["year:=2001"]) == [1] and find(["title::^O"]) == [2]
    assert find(["yt:a", "yt:b"]) == [1, 2] and find(["yt:a", "title:other"]) == []
    assert find(["lyrics:timed"]) == [1] and find(["lyrics:none"]) == [2] and find(["^has:mood"]) == [2]
    assert views.orderBy("song_no").select(terms.output("{key}: {artist} {none}").alias("x")).first()["x"] == "yt:a: X; Yé "
    for bad in (["lyrics:loud"], ["from::x"], ["^"], ["title::("]):
        with pytest.raises(terms.Refused):
            terms.parse(bad, {"yt"})
    with pytest.raises(terms.Refused):
        terms.parse_text("", set())
    with pytest.raises(terms.Refused):
        terms.check_fields(terms.parse(["nofield:x"], set()), {"title"}, set())


def test_cleaning(spark):
    df = spark.createDataFrame([("  A  Owl (Official Video) ",), ("Bo - A Song [HD]",), (None,), ("(Official Video)",)], "title string")
    got = [tuple(r) for r in cleaning.cleaned(df, "title", cleaning.TITLE_RULES, context={"artist": F.lit("Bo")}).collect()]
    assert got[0] == ("A Owl", ["tidy.spacing", "packaging.video_tags"])
    assert got[1] == ("A Song", ["packaging.video_tags", "guesswork.title_artist"])
    assert got[2] == (None, []) and got[3] == ("(Official Video)", [])
    off = cleaning.cleaned(df, "title", cleaning.TITLE_RULES, off={"packaging.video_tags"}).first()
    assert off["title"] == "A Owl (Official Video)"


def test_units(spark):
    assert one(spark, M.size_bytes(F.lit("1 K")), M.size_bytes(F.lit("1 KB")), M.size_bytes(F.lit("x")), M.duration_ms(F.lit("2h"))) == (1024, 1000, None, 7_200_000)
    assert one(spark, M.partial_date(F.lit("20240230")), M.partial_date(F.lit("2024-02")), M.partial_date(F.lit("03.02.2024"))) == (None, "2024-02", "2024-02-03")
    assert one(spark, M.backoff_s(F.lit(1)), M.backoff_s(F.lit(3)), M.backoff_s(F.lit(99))) == (3600, 14400, 604800)
    assert one(spark, M.capped_gain(F.lit(500), F.lit(1.0)), M.capped_gain(F.lit(-500), F.lit(1.0))) == (0, -500)
    assert one(spark, T.percent_encoded(F.lit("a b/é")), T.utf16_units(F.lit("a😀")), T.main_script(F.lit("12"))) == ("a%20b%2F%C3%A9", 3, None)
    assert one(spark, T.house_style(F.lit("A ft. B")), T.disc_of_album(F.lit("X (Disc 2)")), T.genre_spelling(F.lit("hip hop"))) == ("A (feat. B)", 2, "Hip Hop")


def test_packed_values():
    known = {"salt, fox & rain": "whole", "drum & bass": "whole", "poe, ann": "whole", "ann": "given", "owl": "name"}
    p = lambda x: [i for _, i, _ in packed.parse(x, known)]
    assert p("Owl; Salt, Fox & Rain") == ["Owl", "Salt, Fox & Rain"]
    assert p("\"Owl\", 'Bo Lee'") == ["Owl", "Bo Lee"] and p("Owl;; ;Bo") == ["Owl", "Bo"]
    assert p("Owl feat. Bo Lee") == ["Owl", "Bo Lee"] and p("Poe, Ann | Lee, Ann") == ["Poe, Ann", "Lee, Ann"]
    assert p("Drum & Bass / Jazz") == ["Drum & Bass", "Jazz"] and p('"Owl, Bo') == ['"Owl', "Bo"]
    assert packed.parse('"Owl, Bo', known)[0][2] == "open quote"
    assert p("Sorry, something went wrong.") == ["Sorry, something went wrong."]
    assert p("") == [] and len(p("; ".join(["Owl"] * 3000))) == 3000


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Crosby, Stills, Nash & Young; Tom Fry", [("Crosby, Stills, Nash & Young", None), ("Tom Fry", None)]), ("Foo Jr.; Bar Sr.", [("Foo Jr.", None), ("Bar Sr.", None)]), ("Man with a Mission, X", [("Man with a Mission", None), ("X", None)]),
        ("(Anna, Berg), Tom Fry", [("(Anna, Berg)", None), ("Tom Fry", None)]), ("(Anna, Berg", [("(Anna", "open bracket"), ("Berg", None)]), ("((A, B), C), D", [("((A, B), C)", None), ("D", None)]), ("Band (UK, London), Other", [("Band (UK, London)", None), ("Other", None)]),
        ("(A, B) C, D", [("(A, B) C", None), ("D", None)]), ('"Anna, Berg", Tom', [("Anna, Berg", None), ("Tom", None)]), ('"Anna, Berg', [('"Anna', "open quote"), ("Berg", None)]), ('"Anna" Berg, Tom Fry', [('"Anna" Berg', "inner quote"), ("Tom Fry", None)]),
        ("Sorry, something went wrong.", [("Sorry, something went wrong.", "prose")]), ("", []), (" ; , ", []), ("Foo Jr., Bar Sr.", [("Foo Jr.", None), ("Bar Sr.", None)]),
    ],
)
def test_packed_grammar(text, want):
    known = {"crosby, stills, nash & young": "whole", "man with a mission": "whole"}
    assert packed.parse(text, known, 4) == [(i, x, f) for i, (x, f) in enumerate(want, 1)]


def test_packed_fields(spark):
    v = spark.createDataFrame([(1, "Owl & Ann Poe", None), (2, None, "Owl"), (3, "", " "), (4, "Owl & Ann Poe", "A x B")], "info_no int, artist string, creator string").withColumn("k", F.lit("clash")).withColumn("items", F.lit(0))
    r = spark.createDataFrame([(["Owl"], "Owl"), (None, None)], "artists array<string>, credit string")
    a = spark.createDataFrame([("Ann Poe",), (None,)], "name string")
    g = spark.createDataFrame([(1, "Folk, World"), (2, "Folk"), (3, "Folk, World; Jazz"), (4, None), (5, "Folk, World")], "genre_no int, name string")
    got = {(x["tab"], x["row_no"], x["field"], x["pos"], x["item"]) for x in packed.found(v, r, a, g).collect()}
    two = lambda n: {("video_infos", n, "artist", 1, "Owl"), ("video_infos", n, "artist", 2, "Ann Poe")}
    assert got == two(1) | two(4) | {("video_infos", 4, "creator", 1, "A"), ("video_infos", 4, "creator", 2, "B"), ("genres", 3, "name", 1, "Folk, World"), ("genres", 3, "name", 2, "Jazz")}
    assert packed.found(v.limit(0), r, a, g.limit(0)).count() == 0


def test_incremental(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d"), (3, None)], "k int, v string")
    got = {r["k"]: r["action"] for r in incremental.diff_merge(old, new, "k").collect()}
    assert got == {1: "keep", 2: "update", 3: "keep", 4: "insert"}
    paths = spark.createDataFrame([(1, "a/B"), (2, "A/b"), (3, "c")], "id int, p string")
    assert {r["id"]: r["path_out"] for r in incremental.separate_paths(paths, "p", "id", "id").collect()} == {1: "a/B", 2: "A/b [2]", 3: "c"}
    same = {"audio": F.lit(1), "tag": F.lit("x"), "side": F.lit(None)}
    assert one(spark, incremental.redo(same, same), incremental.redo(same, same | {"tag": F.lit("y")}), incremental.redo(same, same | {"audio": F.lit(2), "tag": F.lit("y")})) == ("nothing", "tag", "build")


def test_release_order(spark):
    rel = "id string, credit string, on_release struct<id: string, credit: string, group_id: string, release_date: string, status: string, types: array<string>>"
    rows = [("r", "A", ("x", "A", "g", None, "Official", ["Album"])), ("r", "A", ("y", "A", "g", "2001", "Official", ["Album"])), ("r", "A", ("z", "A", "g", "2001-05", "Official", ["Album"])), ("r", "A", ("w", "B", "g", "1990", "Official", ["Album"])), ("r", "A", ("v", "A", "g", "1980", "Official", ["Album", "Live"])), ("q", "A", None)]
    df = spark.createDataFrame(rows, rel)
    assert [tuple(r) for r in catalog.best_release(df).collect()] == [("r", "z", "2001-05")]
    assert {r["edition"] for r in catalog.other_editions(df).collect()} == {"x", "y", "w", "v"}


def test_files(spark, tmp_path):
    (tmp_path / "a.cue").write_text('PERFORMER "P"\nFILE "a.flac" WAVE\n TRACK 01 AUDIO\n  TITLE "One"\n  INDEX 01 00:00:00\n TRACK 02 AUDIO\n  INDEX 01 03:10:37\n')
    (tmp_path / "b.txt").write_text("TITLE=a=b\n# no\nARTIST=c\n")
    cue = [tuple(r)[1:] for r in files.cue_sheets(spark, str(tmp_path)).orderBy("track").collect()]
    assert cue == [("a.flac", 1, "One", "P", None, 0, 190493), ("a.flac", 2, None, "P", None, 190493, None)]
    assert {tuple(r)[1:] for r in files.tag_files(spark, str(tmp_path), "*.txt").collect()} == {(0, "title", "a=b"), (0, "artist", "c")}
    assert files.listing(spark, str(tmp_path)).count() == 2
    assert files.parse_tags("x.json", '{"a": ["b", 1], "c": null}') == [(0, "a", "b"), (0, "a", "1")] and files.parse_tags("x.json", "{") == []
    assert files.settings("[a]\nb = 1\n", {"a.b": int}, ["a.b=2"]) == {"a.b": 2}
    with pytest.raises(ValueError):
        files.settings("x = 1", {})
    assert files.migrate({"old": 1, "new": 2, "o2": 3}, [("old", "new"), ("o2", "n2")]) == {"new": 2, "n2": 3}


def test_snapshots_and_stream(spark, tmp_path):
    from lodeweave.sources import sinks
    from lodeweave.streaming import incremental as stream

    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert [r["action"] for r in sinks.save_diff(spark, str(tmp_path / "t"), 0, a, "k").collect()] == ["insert"]
    assert {(r["k"], r["action"]) for r in sinks.save_diff(spark, str(tmp_path / "t"), 1, b, "k").collect()} == {(1, "update"), (2, "insert")}
    assert sinks.undo(spark, str(tmp_path / "t"), 2).collect() == a.collect()
    src, out = tmp_path / "src", tmp_path / "out"
    run = lambda: stream.measure_stream(spark, str(src), "key string, rev string, n int", str(out), str(tmp_path / "cp"), ["key"], "m1", lambda df: df.withColumn("n2", F.col("n") * 2)).awaitTermination(120)
    spark.createDataFrame([("a", "1", 1), ("b", "1", 2)], "key string, rev string, n int").write.parquet(str(src), mode="append")
    run()
    spark.createDataFrame([("a", "1", 1), ("b", "2", 3)], "key string, rev string, n int").write.parquet(str(src), mode="append")
    run()
    run()
    got = sorted((r["key"], r["rev"], r["n2"]) for r in spark.read.option("basePath", str(out)).parquet(f"{out}/batch=*").collect())
    assert got == [("a", "1", 2), ("b", "1", 4), ("b", "2", 6)]


def test_order_of_rows_does_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/agreed.parquet").select("song_no", "field", F.explode("vals").alias("v"))
    a = {tuple(r) for r in votes.majority(df, ["song_no", "field"], "v").collect()}
    assert a == {tuple(r) for r in votes.majority(df.orderBy(F.rand(1)).repartition(7), ["song_no", "field"], "v").collect()}


def test_whole_tables(spark, tmp_path):
    import __spark_entry__ as entry

    titles = ["Song\u00a0–\u00a0Live (HD)", "Rı\u0301ver", "Moon R\u00edver", "Ri\u200bver Song", "Ｒｉｖｅｒ", "Rivers", "Река River", "Fünf", None, "", "A\u2003| B", "𝒜b"]
    spark.createDataFrame([(i, x, x) for i, x in enumerate(titles)], "info_no int, title string, artist string").write.parquet(f"{tmp_path}/video_infos.parquet")
    credits = ["Ann Poe feat. Ida Wren", "Ann Poe x Ida Wren", "Ann Poe + Ida Wren vs. Owl", "Ann Poe with Ida Wren", "Max", "Änn, Poe", "Änn, Poe", "Ann, Poe", None]
    other = ["Moon River", "River", "Moon Rivér", "", "x"]
    rec = [(i, str(i // 5), x, c, ["x"], (other[i % 5],)) for i, (x, c) in enumerate(zip(titles, credits))]
    spark.createDataFrame(rec, "record_no int, id string, title string, credit string, artists array<string>, on_release struct<title: string>").write.parquet(f"{tmp_path}/records.parquet")
    spark.createDataFrame([(1, "Rock; Pop", 3), (2, "rock", 2), (3, "Drum & Bass", 4), (4, "Pop, ROCK, pop", 1), (5, "Fado", None), (6, None, 9), (7, "Pop", 0)], "genre_no int, name string, votes int").write.parquet(f"{tmp_path}/genres.parquet")
    got = lambda name: {tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    assert got("genre_votes") == {("rock", 6), ("pop", 4), ("drum & bass", 4), ("fado", None)}
    assert got("decoration_count") == {(i, {0: 2, 10: 1}.get(i, 0)) for i, x in enumerate(titles) if x is not None}
    assert {i for (i,) in got("whole_word")} == {2, 3, 4, 6}
    parts = ["Ann Poe|Ida Wren"] * 2 + ["Ann Poe|Ida Wren|Owl", "Ann Poe|Ida Wren", "Max", "Änn|Poe", "Änn|Poe", "Ann|Poe"]
    assert got("credit_split") == {(i, credits[i], 1, x) for i, x in enumerate(parts)}
    assert got("artist_spelling") == {("0", c, 1) for c in credits[:5]} | {("1", "Änn, Poe", 2)}
    fold = dict(got("fold_text"))
    assert (fold[2], fold[6], fold[7], fold[11], len(fold)) == ("moon river", "река river", "funf", "𝒜b", 11)

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {(i, far(t, o[0]), round(far(t, o[0]) / max(len(t), len(o[0])), 3)) for i, _, t, _, _, o in rec if t is not None}
    assert got("edit_distance") == want


def test_print_pairs_are_all_pairs_of_a_song(spark, tmp_path):
    import __spark_entry__ as entry

    said = lambda n: " ".join(f"w{(i * i + n * 7919) % 100003}" for i in range(60))
    texts = [(1, said(1), 5), (2, said(2), 5), (3, "intro " + said(1), 5), (4, said(1), 5), (5, said(1), 6), (6, said(1), 7), (7, said(2), 7), (8, "", 5), (9, None, 5)]
    spark.createDataFrame(texts, "doc_id bigint, text string, song_no bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["a"], r["b"]): (r["offset"], r["agreeing"]) for r in entry.queries()["print_pairs"](spark, str(tmp_path)).collect() if r["verdict"] == "same"}
    assert got == {(1, 3): (-1, 60), (1, 4): (0, 60), (3, 4): (1, 60)}


def test_print_pairs_are_joined_without_broadcasts(spark, tmp_path):
    """The driver holds no side of a join, and the documents are read by one scan, not one for each join."""
    import __spark_entry__ as entry

    texts = [(i, " ".join(f"w{(j * j + i * 7919) % 1009}" for j in range(60)), i % 3) for i in range(9)]
    spark.createDataFrame(texts, "doc_id bigint, text string, song_no bigint").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = entry.queries()["print_pairs"](spark, str(tmp_path))
    assert pairs.count() == len(pairs.collect())
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan and "documents.parquet" not in plan


def test_bandwidth_of_a_quiet_start():
    from lodeweave.operators import media

    t = np.arange(100_000) / 44_100
    loud = np.where(t > 1, np.sin(2 * np.pi * 9000 * t), 0.001 * np.sin(2 * np.pi * 200 * t))
    assert abs(media.sound_quality(loud, 44_100)[0] - 9000) < 100
