import ast
import gzip
import json

import numpy as np
import pytest
from conftest import rows

from tablewright.plans.recipes import RECIPES, behance, dataset_catalog, integrate
from tablewright.sources import binary, files


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def put_json(path, records):
    return put(path, "".join(json.dumps(r) + "\n" for r in records))


def put_literals(path, records):
    return put(path, "".join(repr(r) + "\n" for r in records))


def test_csv_types_missing_values_and_quotes(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'n,x,b,s,m\n1,1.5,True,"a ""q"",\nline",NA\n,NaN,,null,\n3,1e3,False,N/A,\n')
    df = files.read_csv(spark, path, multiline=True)
    assert df.dtypes == [("n", "bigint"), ("x", "double"), ("b", "boolean"), ("s", "string"), ("m", "string")]
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, True, 'a "q",\nline', None), (None,) * 5, (3, 1000.0, False, None, None)]


def test_load_table_by_suffix(spark, tmp_path):
    assert files.load_table(spark, put(tmp_path / "a.csv", "x;y\n1;2\n"), sep=";").first()["y"] == 2
    assert files.load_table(spark, put_json(tmp_path / "a.jsonl", [{"x": 1}, {"y": "t"}])).count() == 2
    with pytest.raises(ValueError):
        files.load_table(spark, "a.xlsx")


@pytest.mark.parametrize("multiline", [True, False])
def test_only_lines_with_too_many_fields_are_skipped(spark, tmp_path, multiline):
    path = put(tmp_path / "a.csv", 'a,b,c\n1,2,3\n1,2\n4\n1,2,3,4\n1,2,3,\n1,2,3,,5\n1,2,3,4,5,6\n"x,y",2,"z,,"\n')
    got = files.read_csv_skip_bad(spark, path, multiline=multiline)
    assert rows(got) == sorted([("1", 2, "3"), ("1", 2, None), ("4", None, None), ("x,y", 2, "z,,")], key=repr)


def test_literals_are_never_executed(spark, tmp_path):
    path = put(tmp_path / "a.json", "{'a': True, 'b': None, 'c': u'caf\\xe9', 'd': (1, 2)}\n\n{'a': False}\n")
    df = files.read_pyliteral_lines(spark, path, "a boolean, b string, c string, d array<int>")
    assert [tuple(r) for r in df.collect()] == [(True, None, "café", [1, 2]), (False, None, None, None)]
    assert files.read_pyliteral_lines(spark, path).columns == ["a", "b", "c", "d"]
    with pytest.raises(Exception, match="malformed|literal"):
        files.read_pyliteral_lines(spark, put(tmp_path / "b.json", "__import__('os').getcwd()\n"), "a int").collect()


def test_gzip_and_json_maps(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"x": 1}\n{"x": 2}\n')
    assert files.read_gzip(spark, str(tmp_path / "a.json.gz"), "x int", 4).count() == 2
    path = put(tmp_path / "m.json", json.dumps({"e1": [{"a": 1, "z": 0}, {"a": None}], "e2": []}))
    assert rows(files.read_json_records(spark, path, "a int, b string", key="e")) == sorted([("e1", 1, None), ("e1", None, None)], key=repr)
    pairs = put(tmp_path / "p.json", json.dumps({"k": "v", "w": None}))
    assert rows(files.read_json_pairs(spark, pairs, "key", "value")) == sorted([("k", "v"), ("w", None)], key=repr)


def record(number, values):
    return f"{number:08d}".encode() + np.array(values, dtype="<f4").tobytes()


@pytest.mark.parametrize("tail", [b"", b"0000", b"00000003" + b"\0" * 7])
def test_truncated_record_is_left_out(spark, tmp_path, monkeypatch, tail):
    monkeypatch.setattr(binary, "CHUNK_BYTES", 60)  # two records per range
    path = tmp_path / "f.b"
    path.write_bytes(b"".join(record(i, [i, i + 0.5, -i, 0]) for i in range(7)) + tail)
    got = rows(binary.read_fixed_binary(spark, str(path), dim=4))
    assert got == [(i, [i, i + 0.5, -i, 0]) for i in range(7)]


def fill(root):
    """Small files for every dataset: null and unmatched keys, empty lists, missing fields."""
    put(root / "Twitch/100k_a.csv", "1,34347669376,grimnax,5415,5419\n1,34391109664,jtgtv,5869,NA\n")
    put(root / "NPR/episodes.csv", "id,program,episode_date\n1,a,2001\n2,b,2002\n,c,2003\n")
    put(root / "NPR/utterances.csv", "episode,order,utterance\n1,0,hello\n1,1,\"two\nlines\"\n9,0,none\n,0,null key\n")
    for i, part in enumerate(("train", "valid", "test")):
        said = [{"episode": f"ep-{i}", "act": "one", "utterance_start": 0.5, "utterance_end": 1.5, "speaker": "s", "utterance": "u", "other": 1}, {"episode": f"ep-{i}"}]
        put(root / f"This American Life/{part}-transcripts-aligned.json", json.dumps({f"ep-{i}": said, f"empty-{i}": []}))
    put(root / "Recipes/RAW_interactions.csv", "user_id,recipe_id,rating\n1,10,5\n2,10,4\n3,99,1\n")
    put(root / "Recipes/RAW_recipes.csv", "name,id,minutes\nsoup,10,20\ncake,11,60\n")
    put_literals(root / "EndoMondo/raw.json", [])
    with gzip.open(root / "EndoMondo/endomondoHR.json.gz", "wt") as f:
        f.write("{'userId': 1, 'heart_rate': [100, 101], 'sport': 'bike'}\n{'userId': 2, 'sport': 'run'}\n")
    put_json(root / "Amazon Product Reviews/Video_Games_5.json", [{"overall": 5.0, "verified": True, "style": {"Format:": "x"}}, {"overall": 1.0, "verified": False}])
    qa = root / "Amazon Question and Answer"
    put_literals(qa / "qa_Video_Games.json", [
        {"asin": "A", "questionType": "yes/no", "answerType": "Y", "answerTime": "t", "unixTime": 5, "question": "q?", "answer": "a"},
    ])
    put_literals(qa / "QA_Video_Games copy.json", [
        {"asin": "B", "questions": [
            {"questionType": "open", "questionText": "why?", "answers": [{"answerText": "so", "helpful": [1, 2]}, {"answererID": "z"}]},
            {"questionType": "open", "askerID": "k", "answers": []}, {"questionType": "open"},
        ]},
        {"asin": "C", "questions": []},
    ])
    put(root / "Amazon Marketing Bias/df_electronics.csv", "item_id,user_id,rating\n0,Tom,5.0\n")
    put(root / "ModCloth Marketing Bias/df_modcloth.csv", "item_id,user_id,rating\n7,Ann,4\n8,Bob,\n")
    put_json(root / "Google Local/review-Hawaii_10.json", [{"gmap_id": "g1", "name": "u", "rating": 5}, {"gmap_id": "g9", "name": "v"}, {"gmap_id": None, "name": "w"}])
    put_json(root / "Google Local/meta-Hawaii.json", [{"gmap_id": "g1", "name": "shop"}, {"gmap_id": None, "name": "nowhere"}])
    review = {"item_id": "10", "review": "good", "recommend": True, "posted": "p", "last_edited": "", "funny": "", "helpful": "1"}
    put_literals(root / "Steam/australian_user_reviews.json", [{"user_id": "u", "user_url": "url", "reviews": [review]}, {"user_id": "v", "user_url": "x", "reviews": []}])
    item = {"item_name": "n", "playtime_forever": 6, "playtime_2weeks": 0}
    put_literals(root / "Steam/australian_users_items.json", [
        {"user_id": "u", "items_count": 2, "steam_id": "s", "user_url": "url", "items": [{"item_id": "10", **item}, {"item_id": "20", **item}]},
        {"user_id": "w", "items_count": 0, "steam_id": "s", "user_url": "x", "items": []},
    ])
    put_literals(root / "Steam/steam_games.json", [{"id": "10", "title": "Game", "price": 9.99}, {"title": "no id"}])
    bundle = {"bundle_final_price": "$1", "bundle_url": "b", "bundle_price": "$2", "bundle_name": "n", "bundle_discount": "50%"}
    put_literals(root / "Steam/bundle_data.json", [
        {**bundle, "bundle_id": "1", "items": [{"item_id": "10", "discounted_price": "$1"}, {"item_id": "30", "discounted_price": "$2"}]},
        {**bundle, "bundle_id": "2", "items": [{"item_id": "10", "discounted_price": "$3"}]},
    ])
    base = {"user_id": "u", "book_id": "b1", "review_id": "r1", "rating": 4, "date_added": "d", "date_updated": "d", "read_at": None, "started_at": ""}
    put_json(root / "Goodreads Book Reviews/goodreads_interactions_poetry.json", [{**base, "is_read": True}, {**base, "review_id": "r2", "book_id": "b9"}])
    put_json(root / "Goodreads Book Reviews/goodreads_reviews_poetry.json", [{**base, "review_text": "fine", "n_votes": 1}])
    put_json(root / "Goodreads Book Reviews/goodreads_books_poetry.json", [{"book_id": "b1", "title": "Poems"}])
    put_json(root / "Goodreads Spoilers/goodreads_reviews_spoiler.json", [{"review_id": "r", "has_spoiler": True, "review_sentences": [[0, "a"], [1, "b"]]}])
    put_json(root / "Pinterest/fashion.json", [{"product": "p1", "scene": "s1"}, {"product": "p9", "scene": "s2"}])
    put_json(root / "Pinterest/home.json", [{"product": "h1", "scene": "s3"}])
    put(root / "Pinterest/fashion-cat.json", json.dumps({"p1": "Apparel|Shoes"}))
    put(root / "Pinterest/home-cat.json", json.dumps({"h1": "Home", "h2": "Other"}))
    put_json(root / "ModCloth Clothing Fit/modcloth_final_data.json", [{"item_id": "1", "fit": "small", "waist": "29"}])
    put_json(root / "RentTheRunway Clothing Fit/renttherunway_final_data.json", [{"fit": "fit", "rating": "10"}, {"fit": "large"}])
    put_literals(root / "Tradesy/tradesy.json", [{"uid": "1", "lists": {"selling": [], "sold": ["3"], "want": ["4", "5"], "bought": []}}])
    put(root / "Behance/Behance_appreciate_1M", "1 100 1300000000\n2 100 1300000001\n3 300 1300000002\n")
    put(root / "Behance/Behance_Item_to_Owners", "100 8\n100 7\n200 9\n")
    (root / "Behance/Behance_Image_Features.b").write_bytes(record(100, [1, 2, 3, 4]) + record(300, [0, 0, 0, 1]) + b"00000400" + b"\0" * 5)
    put_json(root / "Librarything/reviews.json", [
        {"work": "w", "user": u, "comment": "c", "time": "t", "unixtime": 1, "flags": [], "stars": 4.5, "nhelpful": 0, "extra": 1} for u in ("ann", "zoe")
    ])
    put(root / "Librarything/edges.txt", "ann bob\ncat ann\nann bob\n")
    put_literals(root / "RateBeer Multi-aspect Reviews/ratebeer.json", [{"beer/name": "x", "review/overall": "13/20"}])
    put_literals(root / "BeerAdvocate Multi-aspect Reviews/beeradvocate.json", [{"beer/name": "y", "beer/ABV": "5"}])
    put(root / "Reddit Submissions/submissions.csv", "#image_id,unixtime,title\n0,1333172439,a\n0,1333178161,b,extra\n1,1333199913\n")
    return str(root)


@pytest.fixture(scope="module")
def root(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("data")
    out = fill(root)
    spark.createDataFrame([(1, "soup"), (2, "cake"), (3, "stew")], "id long, name string").write.parquet(f"{out}/Paired Recipes/recipes.parquet")
    spark.createDataFrame([(1, 2, "t"), (1, 9, "f"), (3, 1, "t")], "base long, target long, label string").write.parquet(f"{out}/Paired Recipes/pairs.parquet")
    return out


def test_every_dataset_is_integrated(spark, root):
    assert dataset_catalog(spark).count() == len(RECIPES) == 22
    counts = {name: integrate(spark, name, root).count() for name in RECIPES if name != "behance"}
    assert counts == {
        "twitch": 2, "npr": 3, "this_american_life": 6, "food_reviews": 2, "paired_recipes": 2, "endomondo": 2, "product_reviews": 2,
        "product_answers": 3, "electronics_bias": 1, "modcloth_bias": 2, "local_reviews": 2, "steam": 3, "goodreads": 2, "goodreads_spoilers": 1,
        "pinterest": 3, "modcloth_fit": 1, "runway_fit": 2, "tradesy": 1, "librarything": 2, "beer_reviews": 2, "reddit": 2,
    }
    assert integrate(spark, 1, root).columns == ["User_ID", "Stream_ID", "Streamer_username", "Time_start", "Time_stop"]
    with pytest.raises(ValueError):
        integrate(spark, 23, root)


def test_dialogs_match_null_keys(spark, root):
    df = integrate(spark, "npr", root)
    assert df.columns == ["episode", "program", "date", "order", "utterance"]
    assert rows(df, "episode", "utterance") == sorted([(1, "hello"), (1, "two\nlines"), (None, "null key")], key=repr)


def test_answers_of_both_files(spark, root):
    df = integrate(spark, "product_answers", root)
    assert len(df.columns) == 11
    assert rows(df, "asin", "askerID", "questionText", "answerText", "answererID", "answerUnixTime", "helpful") == sorted(
        [("A", None, "q?", "a", None, 5, None), ("B", "", "why?", "so", "", None, [1, 2]), ("B", "", "why?", "", "z", None, [])], key=repr
    )


def test_steam_fans_out_over_bundles(spark, root):
    got = rows(integrate(spark, "steam", root), "item_id", "review", "title", "bundle_id", "item_discounted_price")
    assert got == sorted([("10", "good", "Game", "1", "$1"), ("10", "good", "Game", "2", "$3"), ("20", None, None, None, None)], key=repr)


def test_other_shapes(spark, root):
    assert rows(integrate(spark, "paired_recipes", root), "base", "target", "name_base", "name_target") == [(1, 2, "soup", "cake"), (3, 1, "stew", "soup")]
    assert rows(integrate(spark, "goodreads", root), "review_id", "review_text", "title") == sorted([("r1", "fine", "Poems"), ("r2", None, None)], key=repr)
    assert rows(integrate(spark, "pinterest", root), "product", "category") == sorted([("p1", "Apparel|Shoes"), ("p9", None), ("h1", "Home")], key=repr)
    assert integrate(spark, "tradesy", root).first().asDict() == {"uid": "1", "selling": [], "sold": ["3"], "want": ["4", "5"], "bought": []}
    assert rows(integrate(spark, "librarything", root), "user", "connections") == sorted([("ann", ["bob", "cat"]), ("zoe", None)], key=repr)
    assert rows(integrate(spark, "reddit", root)) == sorted([(0, 1333172439, "a"), (1, 1333199913, None)], key=repr)
    assert rows(behance(spark, root, dim=4), "user_id", "owner_id", "image_features") == sorted(
        [(1, [7, 8], [1.0, 2.0, 3.0, 4.0]), (2, [7, 8], [1.0, 2.0, 3.0, 4.0]), (3, None, [0.0, 0.0, 0.0, 1.0])], key=repr
    )


@pytest.mark.parametrize("name, content", [("malformed", '{"a": [{"n": 1}], "b": [{"n": '), ("type", '{"a": [{"n": 1}, {"n": "x"}]}'), ("long", '{"a": [{"n": 123456789012345678901234567890}]}')])
def test_json_maps_fail_rather_than_lose_rows(spark, tmp_path, name, content):
    put(tmp_path / "good.json", '{"g": [{"n": 5}]}')
    put(tmp_path / "bad.json", content)
    read = lambda **options: files.read_json_records(spark, str(tmp_path), "n bigint", "k", **options).collect()
    with pytest.raises(Exception, match="MALFORMED|malformed|cannot|Cannot|parse"):
        read()
    assert (("g", 5) in {tuple(r) for r in read(on_error="null")}) and pytest.raises(ValueError, read, on_error="maybe")


def test_json_pairs_and_literals_fail_rather_than_turn_null(spark, tmp_path):
    put(tmp_path / "pairs.json", '{"a": 1, "b": "x"}')
    with pytest.raises(Exception, match="MALFORMED|malformed|cannot|Cannot|parse"):
        files.read_json_pairs(spark, str(tmp_path / "pairs.json"), "k", "v", "bigint").collect()
    for k, line in enumerate(["{'n': 'bad'}", "{'n': 123456789012345678901234567890}"]):
        put(tmp_path / f"lines{k}.json", "{'n': 1}\n" + line + "\n")
        path = str(tmp_path / f"lines{k}.json")
        with pytest.raises(Exception, match="MALFORMED|malformed|cannot|Cannot|parse"):
            files.read_pyliteral_lines(spark, path, "n bigint").collect()
        assert rows(files.read_pyliteral_lines(spark, path, "n bigint", on_error="null")) == [(1,), (None,)]


def test_csv_is_split_unless_lines_may_break(spark, tmp_path):
    put(tmp_path / "t.csv", 'a,b\n1,"x\ny"\n2,z\n')
    assert rows(files.read_csv(spark, str(tmp_path / "t.csv"), multiline=True)) == [(1, "x\ny"), (2, "z")]
    assert files.read_csv(spark, str(tmp_path / "t.csv")).count() == 3


@pytest.mark.parametrize(
    "line",
    [
        "{u'a': 'b', 'n': None, \"k\": [1, 2.5, True]}", "{'a': 'it\\'s'}", "{'a': ('x', 'y'),}", "{'a' 'b': 1}", "{1: 'x'}", '{"a": "it\'s True"}',
        "{'a': \'\'\'q\'\'\'}", "{'True': -0.0, 'e': 1e5}", "{}", "{'a': 'x', 'a': 'y'}", "{'a|b': 'c|d'}", '{"a": "null"}', '{"a": [1, {"b": "\u00e9"}]}',
    ],
)
def test_quick_literals_are_those_of_the_syntax_tree(line):
    assert files.literal_to_json(line) == json.dumps(ast.literal_eval(line))


@pytest.mark.parametrize("line", ['{"a": true}', '{"a": NaN}', "{'a': null}", "{'a' | 'b'}", "open('x')"])
def test_what_is_no_literal_raises(line):
    with pytest.raises((ValueError, SyntaxError)):
        files.literal_to_json(line)


def test_plain_lines_need_no_syntax_tree(monkeypatch):
    monkeypatch.setattr(files.ast, "literal_eval", None)
    assert json.loads(files.literal_to_json("{'a': \"it's\", u'b': [None, -1.5]}")) == {"a": "it's", "b": [None, -1.5]}
