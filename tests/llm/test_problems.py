"""The training-data operators against brute force and hand-worked cases, with nulls, empty and long texts, ties, repeats and clashing columns."""

import itertools
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import leaks, linkage, lookalike, merkle, mixing, names, pii, residue, survivor

VIDEO = (
    "info_no bigint, source_key string, title string, track string, artist string, creator string, album string, channel string, upload_date string, "
    "duration_s double, trust int, seen_at timestamp_ntz, text string, n bigint, tab string, field string"
)
RECORD = "record_no bigint, id string, title string, artists array<string>, credit string, disambiguation string, length_ms bigint, trust int, seen_at timestamp_ntz, on_release struct<title: string, release_date: string, country: string, label: string, barcode: string>, text string, n bigint"


def videos(spark, rows):
    keys = [c.strip().split(" ")[0] for c in VIDEO.split(",")]
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], VIDEO)


def records(spark, rows):
    keys = ["record_no", "id", "title", "artists", "credit", "disambiguation", "length_ms", "trust", "seen_at", "on_release", "text", "n"]
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], RECORD)


def rows(df):
    return {tuple(r) for r in df.collect()}


def aliases(spark, plain, other=()):
    return spark.createDataFrame([(n, True) for n in plain] + [(n, False) for n in other] + [(None, None)], "name string, is_primary boolean").withColumn("n", F.lit("clash")).withColumn("k", F.lit(1))


# --- 1


@pytest.mark.parametrize(
    ("variant", "canonical", "can"),
    [
        ("ANN POE", "Ann Poe", True), ("Poe, Ann", "Ann Poe", True), ("AnnPoe", "Ann Poe", True), ("J. Harrow", "James Harrow", True), ("Jim Harrow", "James Harrow", True), ("Jaems Harrow", "James Harrow", True),
        ("James K. Harrow", "James Harrow", True), ("Rose Harrow", "James Harrow", False), ("R. Harrow", "James Harrow", False), ("Vale Phil. Orch.", "Vale Philharmonic Orchestra", True), ("Vale RSO", "Vale Radio Symphony", True),
        ("Mölk Singers", "Moelk Singers", True), ("Owls, The", "The Owls", True), ('Ann "Red" Poe', "Ann Poe", True), ("", "Ann Poe", False), ("Vale Orchestra", "Orchestra of Vale", True),
    ],
)
def test_channel(variant, canonical, can):
    a, b = names.features(variant), names.features(canonical)
    assert (names.channel(a["words"], set(a["dotted"]), b["words"]) is not None) == can


def test_channel_is_learned(spark):
    """Initials make most variants here, so their chance grows from the one the rounds begin with, and that of nicknames falls."""
    done = lambda **n: [float(n.get(o, 0)) for o in names.OPERATIONS]
    data = [(f"v{i}", f"c{i}", 3, True, done(initial=1)) for i in range(300)] + [(f"w{i}", f"c{i}", 3, True, done(typo=2)) for i in range(60)]
    got = names.learned_channel(spark.createDataFrame(data, "name string, to string, m int, p boolean, done array<double>"))
    assert got["initial"] > -0.4 > names.CHANNEL["initial"] and -2.2 < got["typo"] < -1.5 and got["nick"] < -4
    assert names.learned_channel(spark.createDataFrame([], "name string, to string, m int, p boolean, done array<double>")) == pytest.approx(names.CHANNEL, abs=0.01)


def test_slips_against_plain_table():
    def plain(a, b):
        d = {}
        for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
            d[i, j] = max(i, j) if not i or not j else min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    r = np.random.default_rng(0)
    for _ in range(400):
        a, b = ("".join(r.choice(list("abc"), r.integers(0, 7))) for _ in "xy")
        assert names.slips(a, b, 9) == plain(a, b)


def test_spellings_are_linked(spark):
    plain = ["James Harrow", "Rose Harrow", "Vale Brothers", "Salt, Fox & Rain", "Ann Poe"]
    al = aliases(spark, plain, ["J. Harrow", "James Harrwo", "VALE BROTHERS", "", "Harrow, Jim", "J. Harrow"])
    r = records(spark, [{"artists": [n] * 2, "credit": n} for n in [*plain, "James Harrow", "Salt, Fix & Rain", None]] + [{"artists": None}, {"artists": []}])
    v = videos(spark, [{"artist": "Ann Poe & Rose Harrow"}, {"artist": "ann poe"}, {"artist": "Various Artists"}, {"artist": "{artist}"}, {"artist": "  "}, {}, {"artist": "Z" * 5000}])
    got = rows(names.found(r, al, v))
    groups = [{"James Harrow", "J. Harrow", "James Harrwo", "Harrow, Jim"}, {"Vale Brothers", "VALE BROTHERS"}, {"Ann Poe", "ann poe"}, {"Salt, Fox & Rain", "Salt, Fix & Rain"}]
    assert got == {p for g in groups for p in itertools.combinations(sorted(g), 2)}
    assert names.found(r.limit(0), al.limit(0), v.limit(0)).count() == 0


def test_plans_of_spellings_stay_small(spark):
    """The driver plans a query anew at each of its stages, so its memory is set by the largest plan: none has over 100 nodes."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    al = aliases(spark, ["James Harrow", "Vale Brothers"], ["J. Harrow", "Harrow, Jim"])
    r = records(spark, [{"artists": ["Vale Brothers"], "credit": "Vale Bros."}])
    assert names.found(r, al, videos(spark, [{"artist": "VALE BROTHERS"}, {"artist": "Ann & Vale"}])).count() == 6
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList(before, 10_000)
    sizes = [store.planGraph(ran.apply(i).executionId()).allNodes().size() for i in range(ran.size())]
    assert len(sizes) > 10 and max(sizes) <= 100


def test_names_of_common_words_are_linked(spark, monkeypatch):
    monkeypatch.setattr(names, "COMMON", 1)  # nearly every word is common
    plain = ["James Harrow", "Robert Harrow", "Rose Harrow", "James Winter", "Robert Winter", "Rose Winter", "Vale Philharmonic Orchestra", "Mount Philharmonic Orchestra", "Vale Chamber Orchestra", "Winter"]
    variants = {"J. Harrow": "James Harrow", "Harrow, Bob": "Robert Harrow", "Jaems Winter": "James Winter", "Robert Wintre": "Robert Winter", "Rsoe Harrow": "Rose Harrow", "James K. Winter": "James Winter", "V. Philharmonic Orchestra": "Vale Philharmonic Orchestra", "Mount Philharmonc Orchestra": "Mount Philharmonic Orchestra", "Wintr": "Winter"}
    data = [(x, 9, True) for x in plain] + [(x, 1, False) for x in variants]
    got = rows(names.attributed(spark.createDataFrame(data, "name string, n bigint, plain boolean")))
    assert got == {(x, x) for x in plain} | set(variants.items())


def test_common_words_leave_nothing_out(spark, monkeypatch):
    """The links are those of blocks of any size: slips of two letters, of first letters, of short words and of spaces beside a common word."""
    variants = {
        "Mibaudonsk Draitov": "Mubeudonsk Draitov", "Vera Ann Draitov": "Veraan Draitov", "Golniest Lo": "Golniest", "Lars Xoliest Draitov": "Lars Golniest Draitov", "Jim P. Ohchestra": "Kim Philharmonic Orchestra",
        "Robert James K": "James Robert", "Bob Winetr": "Robert Winter", "Karsur Vo": "Karsur Va", "Tarl Gilniest Dratov": "Karl Golniest Draitov",
        "Lars Bob M. A. Golniest Drxitov Karsur": "Lars Robert Milo Anna Golniest Draitov Karsur",
    }
    plain = sorted(set(variants.values()))
    data = [(x, 9, True) for x in plain] + [(x, 1, False) for x in variants]
    data = spark.createDataFrame(data, "name string, n bigint, plain boolean")
    got = {}
    for common in (10**9, 1, 0):
        monkeypatch.setattr(names, "COMMON", common)
        got[common] = rows(names.attributed(data))
    assert got[10**9] == got[1] == got[0] == {(x, x) for x in plain} | set(variants.items())


def test_texts_two_slips_apart_are_met(spark, monkeypatch):
    r = np.random.default_rng(1)
    texts = sorted({"".join(r.choice(list("ab"), r.integers(0, 9))) for _ in range(150)})
    want = {(a, b) for a in texts for b in texts if a != b and names.slips(a, b, 2) <= 2}
    data = spark.createDataFrame([(t, True, True) for t in texts], "x string, asks boolean, offers boolean")
    for long in (40, 4):
        monkeypatch.setattr(names, "LONG", long)
        got = rows(names._close(data))
        assert want <= got and all(names.slips(a, b, 4) <= 4 for a, b in got)


# --- 2


def test_residue_is_told_from_names(spark):
    names_ = [f"{a} {b}" for a in ("Vera", "Ines", "Milo", "Otis", "Thea") for b in ("Karsur", "Draitov", "Golniest", "Mubaud", "Wendlin", "Not Found", "Errors", "Template")]
    forms = ["${%s}", "{{ %s }}", "<your %s here>", "An error occurred while loading %s", "Please enable JavaScript to view %s", "lorem ipsum %s", "404 Not Found %s", "[[%s_1]]"]
    rs = [{"info_no": i, "artist": n} for i, n in enumerate(names_ * 3)] + [{"info_no": 1000 + i, "album": f % w} for i, (f, w) in enumerate(itertools.product(forms, ("artist", "album", "title")))]
    rs += [{"info_no": 2000, "artist": "Unknown Artist"}, {"info_no": 2001, "artist": ""}, {"info_no": 2002}, {"info_no": 2003, "album": "x " * 3000}]
    r = records(spark, [{"record_no": 1, "artists": ["Vera Karsur", "{{ artist }}"]}, {"record_no": 2, "artists": ["Vera Karsur"]}, {"record_no": 3}])
    got = rows(residue.found(videos(spark, rs), r))
    want = {("video_infos", 1000 + i, "album") for i in range(24)} | {("records", 1, "artists")}
    assert len(got & want) >= 24 and not any(n < 1000 and t == "video_infos" or n in (2000, 2001, 2002) for t, n, _ in got)
    assert residue.found(videos(spark, []), r.limit(0)).count() == 0


def test_residue_is_left_out_of_the_rows(spark):
    forms = ["${%s}", "{{ %s }}", "<your %s here>", "Please enable JavaScript to view %s", "lorem ipsum %s", "404 Not Found %s"]
    names_ = [f"{a} {b}" for a in ("Vera", "Ines", "Milo", "Otis") for b in ("Karsur", "Draitov", "Golniest", "Mubaud")]
    vs = [{"info_no": i, "artist": n, "album": f % "album", "title": "T"} for i, (n, f) in enumerate(itertools.product(names_, forms))]
    r = records(spark, [{"record_no": 1, "artists": ["Vera Karsur", "{{ artist }}", None], "title": "R"}, {"record_no": 2, "artists": ["Vera Karsur"]}, {"record_no": 3}])
    got = residue.clean(videos(spark, [*vs, {"info_no": 900, "title": "bare"}]), r).collect()
    v = {x["info_no"]: x for x in got if x["tab"] == "video_infos"}
    assert len(got) == len(vs) + 4 and all(v[x["info_no"]]["artist"] == x["artist"] and v[x["info_no"]]["album"] is None and v[x["info_no"]]["title"] == "T" for x in vs)
    assert {x["record_no"]: x["artists"] for x in got if x["tab"] == "records"} == {1: ["Vera Karsur", None], 2: ["Vera Karsur"], 3: None}


def test_kinds_that_are_not_trusted_are_learned(spark):
    """Only template marks, HTTP lines and the like are trusted; forms that share words or shapes with them are found as well."""
    r = np.random.default_rng(9)
    word = lambda: "".join(r.choice(list("bdfgklmnprst")) + r.choice(list("aeiou")) for _ in range(3)).title()
    good = [f"{word()} {word()}" for _ in range(400)] + [f"{word()} & {word()}" for _ in range(40)] + [f"The {word()}s" for _ in range(60)] + [f"Please Enable {word()}" for _ in range(4)]
    slots = ("artist", "album", "title", "track", "name")
    sure = [f % w for w in slots for f in ("${%s}", "{{ %s }}", "An error occurred while loading %s", "[[%s_1]]", "Placeholder %s", "JavaScript is needed for %s")]
    held = [f % w for w in slots for f in ("[%s name]", "$%s$", "Your %s name", "Insert %s here")]
    assert not any(re.search(residue.TRUST, x) for x in held)
    got = {x["row_no"] for x in residue.found(videos(spark, [{"info_no": i, "artist": x} for i, x in enumerate([*good, *sure, *held])]), records(spark, [])).collect()}
    assert len(got & set(range(len(good) + len(sure), len(good) + len(sure) + len(held)))) >= 0.9 * len(held) and len(got & set(range(len(good)))) <= 4


def test_residue_is_found_however_many_names_there_are(spark, monkeypatch):
    """A table far larger than the fitting sample: often written residue is in it, trusted texts are residue whatever names are like."""
    monkeypatch.setattr(residue, "FIT_OTHERS", 400)
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("bdfgklmnprst")) + r.choice(list("aeiou")) for _ in range(3)).title()
    good = [f"{word()} {word()}" for _ in range(6000)] + [f"{word()} Not Found" for _ in range(600)]
    slots = ("artist", "album", "title", "track", "name")
    bad = [f % w for w in slots for f in ("${%s}", "{{ %s }}", "An error occurred while loading %s", "[[%s_1]]", "Placeholder %s", "[%s name]", "$%s$", "Your %s name", "Insert %s here")]
    texts = [*good, *(x for x in [*bad, "404 Not Found", "Page not found"] for _ in range(40))]
    got = {x["row_no"] for x in residue.found(videos(spark, [{"info_no": i, "artist": x} for i, x in enumerate(texts)]), records(spark, [])).collect()}
    assert len(got & set(range(len(good), len(texts)))) >= 0.85 * (len(texts) - len(good)) and min(got) >= len(good)
    assert got >= {i for i, x in enumerate(texts) if x in ("404 Not Found", "Page not found")}


def test_passages_of_a_field_are_decided_together(spark, monkeypatch):
    """Two elements that are likely residue each make a field residue, one alone doesn't."""
    monkeypatch.setattr(residue, "scored", lambda rows, least: rows.withColumn("p", F.lit(0.6)).filter("text LIKE 'x%'"))
    r = records(spark, [{"record_no": 1, "artists": ["xa", "xb"]}, {"record_no": 2, "artists": ["xa", "xa", "b"]}, {"record_no": 3, "artists": []}])
    assert rows(residue.found(videos(spark, []), r)) == {("records", 1, "artists")}


def test_held_out_accuracy():
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("bdfgklmnprst")) + r.choice(list("aeiou")) for _ in range(3)).title()
    good = [f"{word()} {word()}" for _ in range(300)] + [f"{word()} Not Found" for _ in range(60)]
    bad = [f % r.integers(1, 9999) for f in ("Error %d: page not found", "Session expired (%d)", "JavaScript is required %d", "lorem ipsum %d") for _ in range(40)]
    model = residue.fit(bad[::2], good[::2] + bad[1::2][:20])
    assert np.mean([residue.score(x, model) >= 0.8 for x in bad[1::2]]) > 0.95
    assert np.mean([residue.score(x, model) < 0.8 for x in good[1::2]]) > 0.98
    assert residue.score("", model) == 0.0


# --- 3


def test_linkage(spark):
    words = ["owl", "river", "stone", "lamp", "crow", "field", "glass", "road"]
    rec, vid, want = [], [], {}
    for i, (a, b) in enumerate(itertools.permutations(words, 2)):
        t, who = f"{a.title()} {b.title()}", f"Ann{i} Poe{i}son"
        rec.append({"record_no": 2 * i, "id": f"r{i}", "title": t, "artists": [who], "disambiguation": "", "length_ms": 100_000 + i * 1500})
        rec.append({"record_no": 2 * i + 1, "id": f"l{i}", "title": t, "artists": [who], "disambiguation": "live", "length_ms": 180_000 + i * 1500})
        vid.append({"info_no": 3 * i, "source_key": f"y:{i}", "title": f"{who} - {t} (Official Video)", "duration_s": 101.0 + i * 1.5, "trust": 1})
        vid.append({"info_no": 3 * i + 1, "source_key": f"l:{i}", "title": f"{t} (Live) [HQ]", "artist": who, "duration_s": 180.0 + i * 1.5, "trust": 1})
        want |= {f"y:{i}": f"r{i}", f"l:{i}": f"l{i}"}
    vid += [{"info_no": 9001, "source_key": "slip", "title": "Owl Rivr", "artist": "Ann0 Poe0son", "duration_s": 100.4}, {"info_no": 9002, "source_key": "none", "title": None}, {"info_no": 9003, "source_key": None, "title": "x"}]
    vid += [{"info_no": 9004, "source_key": "other", "title": "Zebra Song", "artist": "Ann0 Poe0son", "duration_s": 100.0}, {"info_no": 9005, "source_key": "y:0", "title": "", "duration_s": None}]
    got = {r["source_key"]: r["record_id"] for r in linkage.link(videos(spark, vid), records(spark, [*rec, {"record_no": 999, "id": None, "title": "x"}, {"record_no": 998, "id": "void"}])).collect()}
    assert "none" not in got and "other" not in got and got.get("slip") == "r0"
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.97 * len(want)
    assert linkage.found(videos(spark, []), records(spark, [])).count() == 0


def test_slips_meet_whatever_else_the_upload_meets(spark):
    who = "Ann Poeson"
    rec = [{"record_no": 1, "id": "drum", "title": "Rising Drum", "artists": [who]}, {"record_no": 2, "id": "no", "title": "Garden No. 37", "artists": [who], "length_ms": 103_000}, {"record_no": 3, "id": "other", "title": "Risin Drum", "artists": ["Ida Wren"], "length_ms": 200_000}]
    vid = [{"info_no": 1, "source_key": "null", "title": f"{who} - Risin Drum"}, {"info_no": 2, "source_key": "one", "title": f"{who} - Garen No. 37", "duration_s": 104.0}, {"info_no": 3, "source_key": "strong", "title": "Risin Drum", "artist": who, "duration_s": 200.0}]
    u, r = linkage.uploads(videos(spark, vid)), linkage.recordings(records(spark, rec))
    got = rows(linkage.candidates(u, r).join(u.select("uid", "source_key"), "uid").join(r.select("rid", "id"), "rid").select("source_key", "id", "title"))
    assert got == {("null", "drum", 2), ("one", "no", 2), ("strong", "drum", 2), ("strong", "other", 3)}


def test_slipped_titles_against_all_pairs(spark):
    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = np.random.default_rng(3)
    titles = sorted({"".join(r.choice(list("ab1"), r.integers(1, 19))) for _ in range(150)})
    for x in titles[:80]:
        y = list(x)
        for _ in range(3):
            i = int(r.integers(0, len(y) + 1))
            y[i : i + int(r.integers(0, 2))] = list("ab"[: r.integers(0, 2)])
        titles += ["".join(y)] if y else []
    titles = sorted(set(titles))
    vid = [{"info_no": i, "source_key": x, "title": x, "artist": "Ann Poeson"} for i, x in enumerate(titles)]
    u, v = linkage.uploads(videos(spark, vid)), linkage.recordings(records(spark, [{"record_no": i, "id": x, "title": x, "artists": ["Ann Poeson"]} for i, x in enumerate(titles)]))
    got = rows(linkage.candidates(u, v).join(u.select("uid", "source_key"), "uid").join(v.select("rid", "id"), "rid").select("source_key", "id"))
    assert got == {(a, b) for a in titles for b in titles if a == b or far(a, b) <= min(3, len(a) // 4)}


def test_label_model_learns_accuracies():
    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.6
    sizes = list(linkage.VOTES.values())
    good = np.array([0.95, 0.9, 0.9, 0.85, 0.6, 0.5])
    votes = [tuple(int(k - 1 if (t == (r.random() < g)) else 1) for k, g in zip(sizes, good)) for t in truth]
    counts = {}
    for v in votes:
        counts[v] = counts.get(v, 0) + 1
    post, learned = linkage.label_model(sorted(counts.items()))
    assert np.mean([(post[v] >= 0.5) == t for v, t in zip(votes, truth)]) > 0.95
    weight = [x["weights"][-1] - x["weights"][1] for x in learned]
    assert weight[0] > weight[4] and all(0 < x["share"] <= 1 for x in learned)


# --- 5


def test_survivors_against_all_pairs(spark):
    r = np.random.default_rng(7)
    base = np.datetime64("2024-01-01")
    data = []
    for i in range(300):
        when = (base + int(r.integers(0, 6))).astype("datetime64[us]").item()
        data.append((f"k{r.integers(0, 60)}" if i % 40 else "hot", i, when, int(r.integers(1, 4)), str(r.choice(["a", "b", "", "  "])) if r.random() < 0.8 else None))
    df = spark.createDataFrame([*data, (None, 999, data[0][2], 3, "x")], "key string, row_no bigint, seen_at timestamp_ntz, trust int, album string").withColumn("rows", F.lit(1)).withColumn("real", F.lit(1))
    held = df.withColumn("album", survivor.real_text(F.col("album")))
    got = {x["row_no"] for x in survivor.survivors(held, ["album"]).filter("sure AND rows > 1").collect()}
    want = set()
    for k, n, t, w, a in data:
        rest = [x for x in data if x[0] == k and x[1] != n]
        if a and a.strip() and rest and all(x[2] < t and x[3] <= w for x in rest if x[4] and x[4].strip()):
            want.add(n)
    assert got == want and want
    assert survivor.survivors(held.limit(0), ["album"]).count() == 0


def test_missing_times_follow_learned_precedence(spark):
    at = lambda d: np.datetime64(f"2024-01-{d:02}").astype("datetime64[us]").item()
    data = [(f"g{i}", 2 * i + j, at(1 + j), 1, ["Song", "Song (Reissue)"][j]) for i in range(8) for j in (0, 1)]
    data += [("u", 100, None, 1, "Tune (Reissue)"), ("u", 101, None, 1, "Tune")]
    df = spark.createDataFrame(data, "key string, row_no bigint, seen_at timestamp_ntz, trust int, album string")
    got = {x["key"]: (x["row_no"], x["sure"]) for x in survivor.survivors(df, ["album"]).collect()}
    assert got["u"] == (100, True) and got["g0"] == (1, True)


def test_undated_rows_are_placed_among_dated_ones(spark):
    at = lambda d: np.datetime64(f"2024-01-{d:02}").astype("datetime64[us]").item()
    # The place of the kind between is told by no first and last value.
    data = [(f"g{i}", 10 * i + j, at(1 + j), 1, ["Song", "Song (Reissue)", "SONG"][j]) for i in range(3) for j in range(3)]
    data += [("after", 100, None, 1, "Tune (Reissue)"), ("after", 101, at(3), 3, "Tune"), ("after", 102, at(2), 1, "Tune")]
    data += [("before", 110, None, 3, "Tune"), ("before", 111, at(3), 1, "Tune (Reissue)")]
    data += [("level", 120, None, 3, "Tune (Reissue)"), ("level", 121, at(3), 1, "Tune (Reissue)")]
    data += [("unlearned", 130, None, 3, "Tune (Reissue)"), ("unlearned", 131, at(3), 1, "Tune (Mono)")]
    data += [("older", 140, None, 3, "Tune (Reissue)"), ("older", 141, at(1), 1, "TUNE"), ("older", 142, at(3), 1, "Tune")]
    data += [("later", 150, None, 3, "Tune (Reissue)"), ("later", 151, at(3), 3, "Tune"), ("later", 152, at(2), 1, "Tune")]
    data += [("earlier", 160, None, 1, "Tune"), ("earlier", 161, at(3), 1, "Tune (Reissue)")]
    data += [("two", 170, None, 1, "Tune (Reissue)"), ("two", 171, None, 1, "Tune (2nd Reissue)"), ("two", 172, at(3), 1, "Tune")]
    data += [("chain", 180, None, 1, "TUNE"), ("chain", 181, None, 1, "Tune (Reissue)"), ("chain", 182, None, 1, "Tune")]
    df = spark.createDataFrame(data, "key string, row_no bigint, seen_at timestamp_ntz, trust int, album string")
    steps = {(x["earlier"], x["later"]): x["n"] for x in survivor.transitions(df.filter("key LIKE 'g%'"), "album", survivor.value_kind(F.col("album"))).collect()}
    assert steps == {("plain", "(reissue"): 3, ("(reissue", "upper"): 3}
    got = {x["key"]: (x["row_no"], x["sure"]) for x in survivor.survivors(df, ["album"]).filter("key NOT LIKE 'g%'").collect()}
    # Trust that is higher elsewhere, a like kind and an unlearned one leave it open which row is the last.
    assert got == {"after": (100, False), "before": (111, False), "level": (121, False), "unlearned": (131, False), "older": (142, False), "later": (150, True), "earlier": (161, True), "two": (171, False), "chain": (180, True)}


def test_learned_order_has_no_rings(spark):
    edges = spark.createDataFrame([("f", "a", "b", 9), ("f", "b", "c", 8), ("f", "c", "a", 7), ("f", "x", "c", 3), ("g", "p", "q", 3)], "field string, earlier string, later string, n int")
    ranks, before = survivor.learned_order(edges)
    assert ranks == {"f": {"a": 1, "b": 2, "x": 1, "c": 3}, "g": {"p": 1, "q": 2}} and before["f"] == {"a": set(), "x": set(), "b": {"a"}, "c": {"a", "b", "x"}}


def test_real_lists(spark):
    df = spark.createDataFrame([(["", None],), ([],), (None,), (["x", ""],)], "v array<string>")
    assert [r[0] for r in df.select(survivor.real_list(F.col("v"))).collect()] == [None, None, None, '["x",""]']


# --- 6


def test_copies(spark):
    base = {"title": "T", "artist": "A", "album": "An Album!", "channel": "C", "upload_date": "20200101", "duration_s": 1.5}
    v = [base | {"info_no": 5}, base | {"info_no": 3, "album": "an  ALBUM"}, base | {"info_no": 4, "upload_date": None}, base | {"info_no": 6, "upload_date": None}, base | {"info_no": 7, "album": "?!"}, base | {"info_no": 8, "album": "??"}, {"info_no": 9}, base | {"info_no": 10, "album": "x" * 20000}, base | {"info_no": 11, "album": "X" * 20000}]
    a = spark.createDataFrame([(1, 1, "F", ["b", "A"]), (2, 1, "F", ["a!", "B"]), (3, 1, "F", ["a", "a", "b"]), (4, 1, "F", None), (5, 1, "F", []), (6, None, "F", ["x"]), (7, None, "F", ["X"]), (8, 1, "F", [None, "x"]), (9, 1, "F", ["x", ""])], "agreed_no bigint, song_no bigint, field string, vals array<string>").withColumn("copies", F.lit("clash")).withColumn("row_no", F.lit(0))
    got = rows(merkle.found(videos(spark, v), a))
    assert got == {("video_infos", 3, 5), ("video_infos", 4, 6), ("video_infos", 10, 11), ("agreed", 1, 2), ("agreed", 6, 7), ("agreed", 8, 9)}
    count = {(r["tab"], r["row_no"]): r["copies"] for r in merkle.collapsed(videos(spark, v), a).collect()}
    assert count["video_infos", 3] == 2 and ("video_infos", 5) not in count and count["agreed", 4] == 1
    assert merkle.found(videos(spark, []), a.limit(0)).count() == 0


def test_collisions_are_split(spark):
    df = spark.createDataFrame([(1, "h", "a"), (2, "h", "b"), (3, "h", "b"), (4, "h", "a"), (5, None, "a")], "no bigint, h string, form string")
    assert {(r["row_no"], r["first_no"]) for r in merkle.copies(df, "no", F.col("h"), F.col("form")).collect()} == {(1, 1), (4, 1), (2, 2), (3, 2)}


# --- 7


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("plain “quoted” – text", None), ("Тихая река", None), ("a\tb\n", None), ("Ｗｉｄｅ　ｔｅｘｔ", "Wide text"), ("Café", "Café"), ("a​b c", "ab c"), ("Раul Smith", "Paul Smith"), ("ΑΒΓ", None), ("oﬃce", "office"), ("Последний пoезд", "Последний поезд"), ("", None), ("Ηumble", "Humble"),
    ],
)
def test_mapped(text, form):
    assert lookalike.mapped(text) == (text if form is None else form)


def test_one_form(spark):
    v = [{"info_no": 1, "title": "Café Owl"}, {"info_no": 2, "title": "Café Owl"}, {"info_no": 3, "title": "Cafe Owl"}, {"info_no": 4, "album": "So​ng"}, {"info_no": 5, "title": None, "album": ""}, {"info_no": 6, "title": "е" + "a" * 30000}]
    df = lookalike.consistent(lookalike.texts(videos(spark, v), records(spark, [{"record_no": 1, "title": "Ｏwl"}, {"record_no": 2}])))
    got = {(r["tab"], r["row_no"], r["field"]): r["canonical"] for r in df.collect()}
    assert got["video_infos", 2, "title"] == "Café Owl" and got["video_infos", 3, "title"] == "Cafe Owl" and got["video_infos", 4, "album"] == "Song" and got["video_infos", 5, "album"] == ""
    assert rows(lookalike.found(videos(spark, v), records(spark, [{"record_no": 1, "title": "Ｏwl"}]))) == {("video_infos", 2, "title"), ("video_infos", 4, "album"), ("video_infos", 6, "title"), ("records", 1, "title")}
    assert lookalike.found(videos(spark, []), records(spark, [])).count() == 0


# --- 8


def test_seeds_hit_every_allowed_passage():
    masks = [[i for i, x in enumerate(m) if x == "1"] for m in leaks.MASKS]
    for n in (18, 19, 23, 24, 25, 30, 35, 36, 37, 47):
        for k in range(n // leaks.ONE_IN + 1):
            for wrong in itertools.combinations(range(n), k) if k < 4 else ():
                assert any(all(s + p not in wrong for p in m) for m in masks for s in range(n - m[-1])), (n, wrong)


def test_leaks_against_all_places(spark, monkeypatch):
    r = np.random.default_rng(2)
    items = [[f"w{x}" for x in r.integers(0, 500, 60)] for _ in range(6)]
    docs, want = [], set()
    for d in range(60):
        i = d % 6
        n, at = int(r.integers(12, 40)), int(r.integers(0, 20))
        part = items[i][at : at + n]
        for p in r.choice(n, size=int(r.integers(0, 4)), replace=False):
            part[p] = "other"
        docs.append([*[f"q{x}" for x in r.integers(0, 900, 30)], *part, *[f"q{x}" for x in r.integers(0, 900, 30)]])
    for d, w in enumerate(docs):
        for i, t in enumerate(items):
            for s in range(-len(t), len(w)):
                lo, hi = max(0, -s), min(len(t), len(w) - s)
                bad = [w[j + s] != t[j] for j in range(lo, hi)]
                if any(12 * sum(bad[a:b]) <= b - a for a in range(len(bad)) for b in range(a + 18, len(bad) + 1)):
                    want.add((d, i))
    text = lambda w, d: ("[00:01.00]" if d % 2 else "> ") + " ".join(x.upper() + ("," if k % 5 else "!\n[01:02.50]") for k, x in enumerate(w))
    ds = spark.createDataFrame([(d, text(w, d)) for d, w in enumerate(docs)] + [(900, None), (901, ""), (902, "x " * 40000)], "doc_id bigint, text string").withColumn("tokens", F.lit(1)).withColumn("seed", F.lit(1))
    it = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(70, None), (71, "too short")], "item_id bigint, text string")
    assert rows(leaks.leaks(ds, it)) == want and want
    monkeypatch.setattr(leaks, "BROADCAST_HASHES", 10)  # the test set is shuffled
    assert rows(leaks.leaks(ds, it)) == want
    assert leaks.leaks(ds.limit(0), it).count() == 0 and leaks.leaks(ds, it.limit(0)).count() == 0


# --- 9


def test_apportionment():
    got = mixing.apportion({"a": Fraction(53), "b": Fraction(24), "c": Fraction(23)}, {"a": 99, "b": 99, "c": 99}, 7)
    assert got == {"a": 3, "b": 2, "c": 2} and sum(mixing.apportion({"a": Fraction(1)}, {"a": 2}, 5).values()) == 2
    assert mixing.largest({}, [("a", 1.0, 1)]) == 0 and mixing.apportion({}, {}, 3) == {}


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 12345])
def test_apportionment_against_single_steps(seats):
    r = np.random.default_rng(seats)
    weights, caps = {f"s{i}": Fraction(int(x), 1000) for i, x in enumerate(r.integers(1, 1000, 9))}, {f"s{i}": int(x) for i, x in enumerate(r.integers(0, 3000, 9))}
    want = dict.fromkeys(weights, 0)
    for _ in range(seats):
        if open_ := [s for s in want if want[s] < caps[s]]:
            want[min(open_, key=lambda s: (-weights[s] / (2 * want[s] + 1), s))] += 1
    assert mixing.apportion(weights, caps, seats) == want


def test_ten_thousand_shards_give_the_whole_quota(spark):
    blocks = {i: 90 + i % 21 if i else 400_000 for i in range(10_000)}  # shard 0 holds a third of all
    shards = spark.createDataFrame([(s, i, n) for s in ("a", "b", "c") for i, n in blocks.items()], "source string, shard int, blocks bigint")
    total = sum(blocks.values())
    wanted = {"a": total // 5, "b": 3, "c": total - 1}
    got = {}
    for r in mixing.shard_quotas(shards, wanted).collect():
        assert 0 <= r["quota"] <= blocks[r["shard"]]
        got.setdefault(r["source"], {})[r["shard"]] = r["quota"]
    assert {s: sum(q.values()) for s, q in got.items()} == wanted
    a = got["a"]
    assert max(blocks[i] / (2 * a[i] + 1) for i in a if a[i] < blocks[i]) <= min(blocks[i] / (2 * a[i] - 1) for i in a if a[i]) + 1e-9  # no seat where another quotient is higher


def test_mix(spark):
    docs = [(i, "word " * (5 + i % 40), "big" if i < 600 else "small" if i < 700 else "none") for i in range(720)] + [(900, None, "big"), (901, "", "big"), (902, "x", None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("shard", F.lit("clash")).withColumn("copies", F.lit(0))
    goals = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), ("gone", 0.0, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mix(d, goals)
    got = {r["source"]: r for r in mixing.shares(m, goals).collect()}
    assert abs(got["big"]["actual_share"] - 0.7) < 0.01 and got["big"]["most_repeats"] == 1 and got["small"]["most_repeats"] <= 3 and got["gone"]["tokens"] == 0
    assert rows(m) == rows(mixing.mix(d.repartition(5), goals))
    many = mixing.mix(d, goals, shard_rows=10)  # 72 shards
    got = {r["source"]: r for r in mixing.shares(many, goals).collect()}
    assert many.select("shard").distinct().count() > 40 and abs(got["big"]["actual_share"] - 0.7) < 0.02 and abs(got["small"]["actual_share"] - 0.3) < 0.02
    assert got["big"]["most_repeats"] == 1 and got["small"]["most_repeats"] <= 3 and got["big"]["tokens"] + got["small"]["tokens"] > 0.95 * sum(r["tokens"] for r in mixing.shares(m, goals).collect())
    assert m.filter("source = 'none' OR doc_id >= 900").count() == 0 and m.select("doc_id").distinct().count() == m.count()
    assert mixing.mix(d.limit(0), goals).count() == 0


# --- 10


def test_personal_information(spark):
    al = aliases(spark, [f"{g} Artist{i}" for g in ("Ann", "Mary-Jo") for i in range(4)] + ["Ann Famous"])
    text = (
        "Ann Private here, I still have it. Cheers to Ann Famous! Mail ann.p+x@inbox.example.net. Write to bo (at) mail (dot) test or cy at post dot example dot org. "
        "Call +49 30 23125 362 or (427) 555-0177, else 0049 (0)30 23125170. SSN 921-43-4407, X26359081, ZZ35 5741 9931 9066 51, QQ 51 81 59 C. Order no. X39-981, barcode 4003985228171, QZ-TL6-15-32162. "
        "Left with Mary-Jo K. Quiet at Apt 4B, 287 Crown Terrace, Dodaisis. Or Fieldstr. 29, 79365 Suseg; 148, rue de la Gare, 35138 Deimport; 388b Empty Wire Road, Fourfield, ZZ39 6DN"
    )
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Ann Private " * 4000), (5, "nothing at home")], "doc_id bigint, text string").withColumn("kind", F.lit("clash")).withColumn("passage", F.lit("x"))
    f = pii.find(d, al)
    want = {
        ("person", "Ann Private"), ("person", "Mary-Jo K. Quiet"), ("email", "ann.p+x@inbox.example.net"), ("email", "bo (at) mail (dot) test"), ("email", "cy at post dot example dot org"), ("phone", "+49 30 23125 362"), ("phone", "(427) 555-0177"),
        ("phone", "0049 (0)30 23125170"), ("id_number", "921-43-4407"), ("id_number", "X26359081"), ("id_number", "ZZ35 5741 9931 9066 51"), ("id_number", "QQ 51 81 59 C"), ("address", "Apt 4B, 287 Crown Terrace, Dodaisis"),
        ("address", "Fieldstr. 29, 79365 Suseg"), ("address", "148, rue de la Gare, 35138 Deimport"), ("address", "388b Empty Wire Road, Fourfield, ZZ39 6DN"),
    }
    assert {tuple(r)[1:] for r in f.filter("doc_id = 1").collect()} == want
    assert {tuple(r) for r in f.filter("doc_id > 1").collect()} == {(4, "person", "Ann Private")}
    red = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in pii.redact(d, f).collect()}
    assert red[1][0].startswith("[PERSON] here, I still have it. Cheers to Ann Famous! Mail [EMAIL]. Write") and red[2] == (None, 0) and red[5] == ("nothing at home", 0)
    assert pii.find(d.limit(0), al).count() == 0 and pii.find(d, al.limit(0)).filter("kind = 'person'").count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("DE00 0000 0000 0000 0000 00", []), ("SSN 000-00-0000", []), ("Our 945-44-1845 again", []), ("123-45-6789 is mine", [("id_number", "123-45-6789")]), ("DE89 3704 0044 0532 0130 00", [("id_number", "DE89 3704 0044 0532 0130 00")]),
        ("DE88 3704 0044 0532 0130 00", []), ("12345678Z there", [("id_number", "12345678Z")]), ("12345678A there", []), ("DNI 12345678A", [("id_number", "12345678A")]), ("order X12345678", []), ("ring 06 12 34 56 78 now", [("phone", "06 12 34 56 78")]),
        ("at https://a.test/555-1234/07700 or x@y.test", [("email", "x@y.test")]), ("İ a@b.test", [("email", "a@b.test")]), ("12 High Street, Oakham LE15 6AB now", [("address", "12 High Street, Oakham LE15 6AB")]),
        ("the Street, Oakham 12345", []), ("@ (at) at a", []), ("10 Low Road, Great Milton 12345", [("address", "10 Low Road, Great Milton 12345")]), ("++((0012", []),
    ],
)
def test_anchors_are_expanded_and_checked(text, want):
    assert [p for p in pii.Finder().passages(text) if p[0] != "person"] == want


def test_fit_without_one_side():
    assert residue.score("lorem ipsum", residue.fit([], ["Vera Karsur"])) < 0.01
    assert residue.score("lorem ipsum dolor", residue.fit(["lorem ipsum a", "lorem ipsum b"], [])) > 0.5
    assert residue.score("x", residue.fit([], [])) < 0.01
